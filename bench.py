"""Times the headline searches over documents at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from quillspan import IndexWriter, Query, Searcher, open_index

    shared = tempfile.mkdtemp(prefix="quillspan-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run: Callable) -> object:
        began = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - began, 3)
        return out

    root = f"file://{shared}/index"
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    i, zero = F.col("doc_id"), F.lit(0)
    dt = F.struct(*[c.cast("int").alias(k) for k, c in zip(("y", "mo", "d", "h", "mi", "s"), (2000 + i % 20, 1 + i % 12, 1 + i % 28, zero, zero, zero), strict=True)])

    def build() -> None:
        w = IndexWriter(spark, root, "overwrite", enable_datetime=True)
        w.define_field("body", tokenize=True, lowercase=True, weight=2.0).define_field("source").define_field("lang")
        w.add_documents(docs, "doc_id", {"body": "text"}, dt).commit()

    timed("index_build", build)
    index = open_index(spark, root)
    q = lambda text, **more: Query(text, tokenize=True, lowercase=True, **more)
    searches = {
        "term": (q("the"), {}),
        "any5": (q("the and that of in"), {}),
        "all5": (q("the and that of in", any_or_all="all"), {}),
        "phrase2": (q('"of the"'), {}),
        "nested": (q("(the AND NOT that) OR (der AND (die OR das))"), {}),
        "field_weighted": (q("src3 the", fields={"source": 0.5, "body": 4.0}), {}),
        "date_range": (q("the", min_date=(2005,), max_date=(2010, 6)), {}),
        "excerpt_page": (q("the and"), {"excerpt_field": "body"}),
    }
    for name, (query, options) in searches.items():
        run = lambda: Searcher(index, **options).add_query(query).search().collect()  # noqa: B023, E731
        timed(f"{name}_cold", run)
        timed(name, run)

    def update() -> None:
        w = IndexWriter(spark, root, "update", 2)
        part = docs.where("doc_id % 100 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000)
        w.add_documents(part, "doc_id", {"body": "text"}, dt).commit()

    timed("update_1pct", update)
    times["postings_rows"] = index.postings.count()
    rows = times.pop("postings_rows")
    total = round(sum(v for k, v in times.items() if not k.endswith("_cold")), 3)
    print(json.dumps({"metric": "full-text index build and searches, total", "value": total, "unit": "sec", "queries": times, "sf": SF_DIR.rpartition("sf")[2], "postings_rows": rows}))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
