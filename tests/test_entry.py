import importlib

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["search_term", "search_nested", "search_phrase3", "search_field_weights", "search_date_range", "token_positions", "stop_filter", "doc_freq", "tombstone_search", "html_search"]


def views():
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "events", "labels", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_entry_runs(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    e = importlib.import_module("__spark_entry__")
    got = e.queries()[name](spark, SF)
    want = views().execute(e.oracle_sql()[name])
    names = [d[0] for d in want.description]
    order = [names.index(c) for c in sorted(names)]
    assert sorted(got.columns) == sorted(names)
    assert rows(got) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)
