"""What is counted where documents are read, and what an index must not move."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quillspan import IndexWriter, Query, Searcher, open_index
from quillspan.functions.analysis import English, Plain
from quillspan.operators.postings import make_counts, make_docs, make_postings, term_totals, with_lengths
from quillspan.operators.search import Index
from quillspan.plans.schema import IndexSchema

TEXTS = [(0, "a b a b"), (1, None), (2, ""), (3, "Body x"), (4, "b a")]


def body(**more):
    return IndexSchema(**more).define_field("body", tokenize=True, lowercase=True).define_field("tag")


def docs(spark, schema, rows=TEXTS):
    df = spark.createDataFrame(rows, "id long, body string").withColumn("tag", F.lit("a"))
    return make_docs(df, schema, "id", doc_num="id")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_need_no_shuffle(spark):
    schema = body()
    df = docs(spark, schema)
    assert "Exchange" not in plan(make_postings(df, schema))
    got = {(r.term, r.doc_num): (r.c_body, r.c_tag) for r in make_counts(df, schema).collect()}
    assert got == {
        ("a", 0): (2, 1), ("b", 0): (2, None), ("a b", 0): (2, None), ("b a", 0): (1, None), ("a", 1): (None, 1), ("a", 2): (None, 1),
        ("a", 3): (None, 1), ("body", 3): (1, None), ("x", 3): (1, None), ("body x", 3): (1, None), ("a", 4): (1, 1), ("b", 4): (1, None), ("b a", 4): (1, None),
    }
    assert make_counts(df.where("false"), schema).count() == 0


def test_pieces_are_counted_apart(spark, monkeypatch):
    from quillspan.operators import postings

    schema = body(language="En")
    df = docs(spark, schema, [(k, " ".join(f"w{j % 7}" for j in range(k % 50))) for k in range(300)]).coalesce(1)
    want = sorted(make_counts(df, schema).collect())
    batch = df.select(F.split("f_body", " ").alias("stem_x")).toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(postings, "PIECE", 60)
    parts = list(postings._pieces(batch, ["stem_x"]))
    assert len(parts) > 50 and sum(p.num_rows for p in parts) == 300
    rows = sum(postings._count(p, [], [("x", False, True)]).num_rows for p in parts)
    assert rows == postings._count(batch, [], [("x", False, True)]).num_rows and want


def test_totals_meet_once(spark):
    schema = body()
    df = term_totals(docs(spark, schema), schema, 3)
    assert plan(df).count("Exchange") == 1
    got = {r.term: (r.doc_freq, r.t_body, r.t_tag) for r in df.collect()}
    assert got["a"] == (5, 3, 5) and got["b a"] == (2, 2, 0) and got["a b"] == (1, 2, 0) and len(got) == 7


def test_counts_and_lengths_give_the_scores(spark, root):
    df = spark.createDataFrame(TEXTS, "id long, body string").withColumn("tag", F.lit("a"))
    with IndexWriter(spark, root, "overwrite") as w:
        w.define_field("body", tokenize=True, lowercase=True).define_field("tag")
        w.add_documents(df, "id", doc_num="id").commit()
    i = open_index(spark, root)
    plain = docs(spark, i.schema)
    want = Searcher(Index(i.schema, plain, make_postings(plain, i.schema))).add_query(Query("a b", tokenize=True)).all_hits()
    got = Searcher(i).add_query(Query("a b", tokenize=True)).all_hits()
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 5
    assert i.docs.columns == plain.columns and "agg" not in i.postings.columns


def test_deletions_move_no_text(spark, root):
    df = spark.createDataFrame(TEXTS, "id long, body string")
    w = IndexWriter(spark, root, "overwrite").define_field("body", tokenize=True)
    w.add_documents(df, "id")
    before = w.added[0]
    w.delete_documents(df.where("id < 3").select("id"))
    assert w.added[0] is before and not w.doc_is_indexed(0) and w.doc_is_indexed(3)
    w.add_documents(df.where("id in (0, 3)").withColumn("body", F.lit("new")), "id")
    assert w.doc_is_indexed(0)
    assert w.commit()["num_docs"] == 3
    i = open_index(spark, root)
    assert "BroadcastHashJoin" in plan(i.docs) and "Exchange hashpartitioning" not in plan(i.docs)
    assert sorted((r.doc_key, r.f_body) for r in i.docs.collect()) == [("0", "new"), ("3", "new"), ("4", "b a")]
    assert {r.term for r in i.postings.collect()} == {"new", "b", "a", "b a"}


def test_deleted_numbers_may_come_again(spark, root):
    df = spark.createDataFrame(TEXTS, "id long, body string")
    w = IndexWriter(spark, root, "overwrite").define_field("body", tokenize=True)
    w.add_documents(df, "id", doc_num="id").delete_documents(df.select("id"))
    w.add_documents(df.where("id = 4"), "id", doc_num="id")
    assert w.commit()["num_docs"] == 1 and [r.doc_key for r in open_index(spark, root).docs.collect()] == ["4"]


def test_third_overwrite_holds_two_versions(spark, root, monkeypatch):
    df, held = spark.createDataFrame(TEXTS, "id long, body string"), []
    write = IndexWriter._write

    def watch(self, *args):
        write(self, *args)
        held.append(len(self.files.names("docs")))

    monkeypatch.setattr(IndexWriter, "_write", watch)
    for _ in range(4):
        with IndexWriter(spark, root, "overwrite") as w:
            w.define_field("body", tokenize=True).add_documents(df, "id").commit()
    assert max(held) == 2


def test_lists_stay_in_arrow(spark):
    df = spark.createDataFrame([("é running dogs",), ("",), (None,)], "t string")
    tokens = df.select(Plain().positions(F.col("t")).alias("p"), English().stem_tokens(F.split("t", " ")).alias("s"))
    assert [tuple(r) for r in tokens.collect()] == [([2, 10], ["é", "run", "dog"]), ([], [""]), (None, None)]
    # 200 is the number of pandas functions, whose lists are objects of Python
    assert ", 200" not in tokens._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_texts_equal_the_patterns():
    pick = random.Random(5)
    for lang in (Plain(), English()):
        for _ in range(200):
            texts = [pick.choice([None, "", "".join(pick.choice("ab'' _9éK\n-") for _ in range(pick.randrange(30)))]) for _ in range(pick.randrange(9))]
            words, row = lang.words(pa.array(["z'z", *texts, "z"], pa.string()).slice(1, len(texts)))
            assert list(zip(row.tolist(), words.to_pylist(), strict=True)) == [(k, w) for k, t in enumerate(texts) for w in re.findall(lang.token_pattern, t or "")]
    assert Plain().set_tokenizer(lambda c: F.split(c, " ")).words is None


def test_texts_are_split_in_arrow(spark):
    for schema in (body(), body(language="En")):
        df = docs(spark, schema)
        assert "regexp_extract_all" not in plan(make_counts(df, schema)) + plan(make_postings(df, schema)) + plan(with_lengths(df, schema)) + plan(term_totals(df, schema, 3))
    df = docs(spark, body(), [(0, "a \t b\x0b"), (1, "\n\n"), (2, " a\u00a0 \r\nb  c d")])
    assert [r.f_body for r in df.orderBy("doc_num").collect()] == ["a b", "", "a\u00a0 b c d"]
    assert {(r.doc_num, r.n_body, r.n_tag) for r in make_counts(df, body(), keep=("doc_num", "n_body", "n_tag")).collect()} == {(0, 2, 1), (1, 0, 1), (2, 4, 1)}
    assert {(r.doc_num, r.n_body, r.n_tag) for r in with_lengths(df, body()).collect()} == {(0, 2, 1), (1, 0, 1), (2, 4, 1)}


def test_null_empty_and_spaced_terms_make_pairs_once():
    from quillspan.operators import postings

    batch = pa.RecordBatch.from_pydict({"stem_x": pa.array([["a", None, None, "b"], ["", "a b", "a", "b"]]), "text_y": pa.array(["a b", "b"])})
    rows = postings._count(batch.append_column("id", pa.array([0, 1])), ["id"], [("x", False, True, None), ("y", False, False, (Plain(), False, False, None))]).to_pylist()
    got = {(r["term"], r["id"]): (r["c_x"], r["c_y"]) for r in rows}
    assert len(got) == len(rows) and got["a b", 0] == (None, 1) and got["", 0] == (1, None) and got["a", 0] == (2, None) and got["b", 0] == (2, None)
    assert got["a b", 1] == (2, None) and got["b", 1] == (1, 1) and got[" a b", 1] == (1, None) and got["a b a", 1] == (1, None)


def test_totals_travel_in_blocks(spark, monkeypatch):
    from quillspan.operators import postings

    pick = random.Random(7)
    rows = [(k, " ".join(pick.choice(["é", "longer_word", *map(str, range(300))]) for _ in range(pick.randrange(60)))) for k in range(400)]
    schema = body()
    df = docs(spark, schema, [*rows, (400, None)])
    counts = make_counts(df, schema)
    want = counts.groupBy("term").agg(F.count(F.lit(1)), F.coalesce(F.sum("c_body"), F.lit(0)), F.coalesce(F.sum("c_tag"), F.lit(0)))
    got = term_totals(df, schema, 5)
    # blocks, not a row a term, pass the exchange
    assert plan(got).count("MapInArrow") == 2 and "Aggregate" not in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert term_totals(df.where("false"), schema, 5).count() == 0
    monkeypatch.setattr(postings, "PIECE", 500)
    batch = pa.RecordBatch.from_pydict({"text_x": pa.array([t for _, t in rows])})
    field = [("x", False, True, (Plain(), True, False, None))]
    whole, names = postings._totals(batch, field), ["doc_freq", "t_x"]
    pieces = [postings._packed(postings._totals(p, field), 3) for p in postings._pieces(batch, ["text_x"])]
    assert len(pieces) > 10
    found = [postings._merged([postings._unpacked(r["n"], r["size"], r["data"], names) for p in pieces for r in p.to_pylist() if r["part"] == k], names) for k in range(3)]
    assert sorted(r for t in found for r in zip(*t.to_pydict().values(), strict=True)) == sorted(zip(*whole.to_pydict().values(), strict=True))
    # parts are near equal, and a term has one
    assert min(t.num_rows for t in found) > 0.8 * whole.num_rows / 3
    raw = sum(r["size"] for p in pieces for r in p.to_pylist())
    assert raw == sum(p["n"] for q in pieces for p in q.to_pylist()) * 12 + sum(len(t.encode()) for p in postings._pieces(batch, ["text_x"]) for t in postings._totals(p, field).column(0).to_pylist())
    assert postings._part_of(pa.array(["", "a", "zz", "a"]).slice(1), 7).tolist()[::2] == [postings._part_of(pa.array(["a"]), 7)[0]] * 2


def test_totals_meet_in_larger_pieces_than_counts(monkeypatch):
    from quillspan.operators import postings

    pick = random.Random(8)
    batch = pa.RecordBatch.from_pydict({"text_x": pa.array([" ".join(pick.choice(["é", *map(str, range(300))]) for _ in range(60)) for _ in range(300)])})
    field = [("x", False, True, (Plain(), True, False, None))]
    monkeypatch.setattr(postings, "PIECE", 500)
    assert len(list(postings._pieces(batch, ["text_x"]))) > 5
    # terms that several pieces of counts hold are sent once
    (block,) = postings._blocks(batch, ["text_x"], field, 3)
    whole = postings._totals(batch, field)
    assert sum(block.column("n").to_pylist()) == whole.num_rows
    # parts don't depend on how many terms are looked at together
    part = postings._part_of(whole.column(0), 3)
    monkeypatch.setattr(postings, "ROWS", 7)
    assert postings._part_of(whole.column(0), 3).tolist() == part.tolist()
    monkeypatch.setattr(postings, "TOTALS", 500)
    assert len(list(postings._blocks(batch, ["text_x"], field, 3))) > 5
