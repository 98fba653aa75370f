import pytest

from quillspan import IndexWriter, Query, Searcher, break_lock, lock_owner, open_index
from quillspan.operators.compaction import segments_to_merge
from quillspan.sources.html import parse_html
from quillspan.sources.store import Files, read_meta


def count(index, text, **more):
    return Searcher(index).add_query(Query(text, **more)).status()["num_hits"]


def test_fields_and_upserts(spark, root):
    w = IndexWriter(spark, root, "overwrite", stoplist=[])
    w.define_field("lowercase", lowercase=True)
    w.define_field("lt", lowercase=True, tokenize=True).define_field("lts", lowercase=True, tokenize=True)
    for text in ("thrEe blind mices", "see how they ruNs") * 2:
        w.add_documents(spark.createDataFrame([(text,)], "t string"), "t", {"lowercase": "t", "lt": "t", "lts": "t"})
    w.commit()
    i = open_index(spark, root)
    assert i.num_docs == 2
    assert count(i, "three blind mices", fields={"lowercase": 1}) == 1
    assert count(i, "thrEe blind mices", fields={"lowercase": 1}) == 0
    assert count(i, "runs", fields={"lt": 1}) == 1
    assert count(i, "see how they runs", fields={"lt": 1}) == 0
    assert count(i, "run", fields={"lts": 1}) == 0
    with pytest.raises(ValueError):
        Searcher(i).add_query(Query("x", fields={"nope": 1}))
    with pytest.raises(ValueError):
        Searcher(i).add_query("x")


def test_dates(spark, root):
    w = IndexWriter(spark, root, "overwrite", stoplist=[], enable_datetime=True).define_field("content", tokenize=True)
    rows = [("a a b", (0, 4, 1, 25, 61, 61)), ("a a a b", (777, 7, 7, 5, 5, 5)), ("a b", (2001, 1, 1, 0, 0, 0))]
    w.add_documents(spark.createDataFrame(rows, "content string, dt struct<y:int,mo:int,d:int,h:int,mi:int,s:int>"), "content", dt="dt")
    w.commit()
    i = open_index(spark, root)
    run = lambda q, **o: [(r.content, round(r.score, 6)) for r in Searcher(i, **o).add_query(q).search().collect()]
    assert run(Query("a", tokenize=True)) == [("a a a b", 0.431523), ("a a b", 0.332187), ("a b", 0.203422)]
    assert [t for t, _ in run(Query("a", tokenize=True, min_date=(500, 0, 0, 0, 0, 0), max_date=(1900,)))] == ["a a a b"]
    assert [t for t, _ in run(Query("a", tokenize=True), sort_by="datetime")] == ["a b", "a a a b", "a a b"]


def test_field_weights(spark, root):
    w = IndexWriter(spark, root, "overwrite", stoplist=[]).define_field("single").define_field("many", tokenize=True)
    many = [" ".join(map(str, range(n + 1))) for n in range(10)]
    many[8] = "0 1 2 3 4 5 6 7 9"
    w.add_documents(spark.createDataFrame([(str(n), m) for n, m in enumerate(many)], "single string, many string"), "single")
    w.commit()
    i = open_index(spark, root)
    assert count(i, "0") == 10 and count(i, "5", fields={"single": 1}) == 1
    got = [(r.single, round(r.score, 6)) for r in Searcher(i).add_query(Query("8", fields={"single": 0.001, "many": 1000})).search().collect()]
    assert [s for s, _ in got] == ["9", "8"] and got[0][1] == pytest.approx(539.0887, abs=1e-3) and got[1][1] == 0.001705


def commit(spark, root, level, rows, mode="update"):
    w = IndexWriter(spark, root, mode, level, stoplist=[]) if mode == "overwrite" else IndexWriter(spark, root, mode, level)
    if not w.schema.fields:
        w.define_field("content")
    w.add_documents(spark.createDataFrame([(r,) for r in rows], "content string"), "content")
    return len(w.commit()["segments"])


def test_segments_deletes_and_locks(spark, root):
    commit(spark, root, 2, [f"d{k}" for k in range(20)], "overwrite")
    assert commit(spark, root, 4, ["a"]) == 2 and commit(spark, root, 4, ["b", "d3"]) == 3
    i = open_index(spark, root)
    assert i.num_docs == 22 and count(i, "d3") == 1
    w = IndexWriter(spark, root)
    with pytest.raises(RuntimeError):
        IndexWriter(spark, root)
    w.delete_documents(["a", "d5", "never"]).commit()
    i = open_index(spark, root)
    assert i.num_docs == 20 and count(i, "d5") == 0 and not i.is_indexed("a") and i.is_indexed("d3")
    assert commit(spark, root, 1, ["c"]) == 1
    i = open_index(spark, root)
    assert i.num_docs == 21 and count(i, "d3") == 1 and count(i, "d5") == 0 and count(i, "c") == 1
    assert read_meta(Files(spark, root))["tombs"] == []  # all merged, nothing replaced
    commit(spark, root, 2, ["new"], "overwrite")
    assert open_index(spark, root).num_docs == 1
    with pytest.raises(ValueError):
        IndexWriter(spark, root, "append")


def test_one_session_deletes_what_it_added(spark, root):
    commit(spark, root, 4, ["old", "kept"], "overwrite")
    w = IndexWriter(spark, root)
    w.add_documents(spark.createDataFrame([("a",), ("b",), ("old",)], "content string"), "content")
    w.add_doc(w.new_doc("one").set_field("content", "one"))
    assert all(w.doc_is_indexed(k) for k in ("a", "one", "kept", "old")) and not w.doc_is_indexed("never")
    assert w.delete_doc("one") == {"content": "one"} and w.delete_doc("kept") == {"content": "kept"} and w.delete_doc("never") is None
    w.delete_documents(spark.createDataFrame([("a",), ("old",)], "k string"))
    assert not any(w.doc_is_indexed(k) for k in ("a", "one", "kept", "old")) and w.doc_is_indexed("b")
    w.add_documents(spark.createDataFrame([("a",)], "content string"), "content")
    assert w.doc_is_indexed("a")
    meta = w.commit()
    i = open_index(spark, root)
    assert sorted(r.doc_key for r in i.docs.collect()) == ["a", "b"] and i.num_docs == 2 == sum(s["live"] for s in meta["segments"])
    assert count(i, "a") == 1 and count(i, "old") == 0


def test_live_counts_follow_the_tombstones(spark, root):
    commit(spark, root, 4, [f"d{k}" for k in range(10)], "overwrite")
    for level, rows in ((4, ["d1", "x", "x"]), (4, ["d2", "x"]), (2, ["d1", "y"]), (1, ["d9"])):
        commit(spark, root, level, rows)
        i, meta = open_index(spark, root), read_meta(Files(spark, root))
        assert i.docs.count() == meta["num_docs"] == sum(s["live"] for s in meta["segments"]) == i.docs.select("doc_md5").distinct().count()


def test_purge_and_lock(spark, root):
    files = Files(spark, root)
    for k in range(4):
        commit(spark, root, 2, [f"x{k}", f"x{k}"], "overwrite")
    assert sorted(files.names("docs")) == sorted(files.names("postings")) == ["seg=2", "seg=3"] and sorted(files.names("tombs")) == ["t=2", "t=3"]
    assert len([m for m in files.names("meta") if m.endswith(".json")]) == 2
    assert count(open_index(spark, root), "x3") == 1 and count(open_index(spark, root), "x2") == 0
    assert lock_owner(spark, root) is None and not break_lock(spark, root)
    w = IndexWriter(spark, root)
    owner = lock_owner(spark, root)
    assert owner["application"] == spark.sparkContext.applicationId and owner["age"] >= 0
    with pytest.raises(RuntimeError, match="application"):
        IndexWriter(spark, root)
    assert not break_lock(spark, root, older_than=3600) and break_lock(spark, root)
    IndexWriter(spark, root).close()
    w.close()


def test_level_three_merges_past_ten_segments(spark, root):
    sizes = [commit(spark, root, 3, [f"w{k}"], "overwrite" if not k else "update") for k in range(12)]
    assert sizes == [*range(1, 11), 1, 2]
    i = open_index(spark, root)
    assert i.num_docs == 12 and all(count(i, f"w{k}") == 1 for k in (0, 5, 11))


def test_one_term_needs_no_shuffle(spark, root):
    commit(spark, root, 1, ["a", "b"], "overwrite")
    i = open_index(spark, root)
    plan = Searcher(i).add_query(Query("a")).all_hits()._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan


def test_small_files_cache_and_fetch(spark, root, tmp_path):
    w = IndexWriter(spark, root, "overwrite", max_records_per_file=3).define_field("content", tokenize=True)
    w.add_documents(spark.createDataFrame([(f"w{k} x",) for k in range(10)], "content string"), "content").commit()
    from pyspark.sql import functions as F

    i = open_index(spark, root, cache_postings=True)
    raw = spark.read.parquet(f"{root}/postings/seg=0").select(F.input_file_name().alias("f")).groupBy("f").count()
    assert raw.agg(F.max("count")).first()[0] <= 3 and i.postings.is_cached
    s = Searcher(i).add_query(Query("x", tokenize=True))
    assert [h["rank"] for h in s.fetch()] == list(range(1, 11)) and {h["content"] for h in s.fetch()} == {f"w{k} x" for k in range(10)}
    i.postings.unpersist()
    (tmp_path / "pages").mkdir()
    for name in ("a", "index"):
        (tmp_path / "pages" / f"{name}.html").write_text(f'<title>T{name}</title><div id="bodytext">one <i>two</i></div>')
    from quillspan.sources.html import read_html_files

    assert [tuple(r) for r in read_html_files(spark, f"file://{tmp_path}/pages").select("url", "title", "bodytext").collect()] == [("a.html", "Ta", "one two")]


def test_merge_policy():
    assert segments_to_merge(1, [5, 1]) == [0, 1] and segments_to_merge(4, [5] * 30) == []
    assert segments_to_merge(2, []) == [] and segments_to_merge(2, [100]) == []
    assert segments_to_merge(2, [100, 9]) == [1] and segments_to_merge(2, [100, 11]) == [0, 1] and segments_to_merge(2, [9, 1, 1]) == [0, 1, 2]
    assert segments_to_merge(3, [7] * 9) == [] and segments_to_merge(3, [7] * 10) == list(range(10))
    segments: list[int] = []
    for _ in range(60):
        drop = segments_to_merge(3, segments)
        segments = [s for k, s in enumerate(segments) if k not in drop] + [1 + sum(segments[k] for k in drop)]
    assert len(segments) <= 10
    with pytest.raises(ValueError):
        segments_to_merge(5, [])


def test_replayed_batch_and_empty_table(spark, root):
    rows = spark.createDataFrame([("a",), ("b",)], "content string")
    for _ in range(2):
        w = IndexWriter(spark, root, optimization=4)
        if not w.schema.fields:
            w.define_field("content")
        w.add_documents(rows, "content").commit(("stream", 0))
    assert open_index(spark, root).num_docs == 2
    assert len(read_meta(Files(spark, root))["segments"]) == 1
    w = IndexWriter(spark, root + "2", optimization=4).define_field("content")
    w.add_documents(rows.limit(0), "content").commit()
    i = open_index(spark, root + "2")
    assert i.num_docs == 0 and count(i, "a") == 0


def test_sort_keys(spark, root):
    w = IndexWriter(spark, root, "overwrite", stoplist=[], enable_sortstring=3).define_field("content", tokenize=True)
    w.add_documents(spark.createDataFrame([("x 1", "aaa"), ("x 2", "abc"), ("x 3", "abzzz"), ("x 4", None)], "content string, k string"), "content", sortstring="k")
    w.commit()
    i = open_index(spark, root)
    find = lambda lo, hi: sorted(r.content for r in Searcher(i).add_query(Query("x", tokenize=True, min_sortstring=lo, max_sortstring=hi)).search().collect())
    assert find("ab", "ab") == ["x 2", "x 3"] and find(None, "aaa") == ["x 1", "x 4"] and find("abz", None) == ["x 3"]


def test_html(spark):
    page = '<html><title>A\nB</title><body class="c"><p>One <b>two</b></p></body></html>'
    got = parse_html(spark.createDataFrame([(page,), (None,)], "html string")).select("title", "bodytext").collect()
    assert [tuple(r) for r in got] == [("A\nB", "One two"), ("", "")]


def test_documents_by_hand(spark, root):
    w = IndexWriter(spark, root, "overwrite", enable_datetime=True, enable_sortstring=2).define_field("content", tokenize=True)
    for k, text in enumerate(["  a \n b ", "a c", None]):
        w.add_doc(w.new_doc(k).set_field("content", text).set_datetime(2000 + k, 1, 1, 0, 0, 0).set_sortstring("k%d" % k))
    w.add_doc(w.new_doc(1).set_field("content", "d"))
    assert w.new_doc(5).set_field("content", " x  y").get_field("content") == "x y" and not w.doc_is_indexed(0)
    with pytest.raises(ValueError):
        w.new_doc(1).set_datetime(1, 2)
    with pytest.raises(ValueError):
        w.add_doc(w.new_doc(1).set_field("other", "x"))
    with pytest.raises(ValueError):
        w.define_field("late")
    w.commit()
    i = open_index(spark, root)
    assert i.num_docs == 3 and count(i, "a", tokenize=True) == 1 and count(i, "d", tokenize=True) == 1
    assert IndexWriter(spark, root).doc_is_indexed(0)
