"""A training-data pipeline over `documents`: toxic texts out, near copies out, benchmark leaks out, sources mixed, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from quillspan.llm.common import anti_join_ids, discard, materialize, row_name
from quillspan.sources.scratch import temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the factorization machine predicts toxic go.

    Rows are judged one by one: null ids and repeated rows pass as they are; null and empty texts score a constant; no
    documents give none; without usable labels the constant decides.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of linked documents the one with the least id stays.

    Of rows that share this id, the one with the least name stays, whatever their texts; of rows equal throughout, one.
    Rows with a null id always stay, as no id can name them, and so do null and wordless texts, which are like nothing.
    No documents give none.
    """
    named = docs.withColumn("__row", row_name(docs))
    # a null id stays a null struct, which the join passes over as least
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "__row")).alias("key")
    found = materialize(ngram_join.ngram_jaccard_join(named.select(key, "text"), "key").select("key", "component_id", "n_shingles"), "found")
    gone = materialize(found.where("key <> component_id").select("key.__row").distinct(), "copies")
    kept = anti_join_ids(named, "__row", gone)
    again = found.where("key = component_id and n_shingles > 0").groupBy("key.__row").count().where("count > 1").select("__row")
    again = materialize(again, "repeated")
    if again.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(again, "__row", "left_semi").dropDuplicates(["__row"])
    return anti_join_ids(kept, "__row", again).unionByName(once).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go.

    Rows are judged one by one: null ids and repeated rows pass as they are; null, empty and wordless texts stay; no
    documents give none, no items drop none.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every document as often as the mix takes it, to whole documents (the straddler is rounded).

    Texts without words have nothing to take and go; no documents give none.

    Rows are told apart by all their columns, so null and repeated ids are mixed like any other; rows equal throughout
    come out as often as the mix takes them together.
    """
    mixed = mixing.mix_documents(docs, row=row_name(docs)).where("taken > 0 and size > 0")
    times = mixed.select(F.col("row").alias("__row"), F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int").alias("times")).where("times > 0")
    times = times.groupBy("__row").agg(F.sum("times").cast("int").alias("times"))
    rows = docs.withColumn("__row", row_name(docs)).dropDuplicates(["__row"])
    return rows.join(times, "__row").withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).select(docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: virtual slot and shard of every document; the session's quillspan.shard.map names a kept map's path.

    Null ids and texts count as empty, repeated rows share a slot, no documents give none.
    """
    return sharding.assign_shards(docs, map_path=spark.conf.get("quillspan.shard.map", None))[0]


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", assign_shards)]

#: The trained model of the first stage has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is a written table, and what a stage needed is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with temporary(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return docs
