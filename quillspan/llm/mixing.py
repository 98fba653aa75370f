"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, once for each pass that the mix may take. A packet is a stretch
of at most PACKET words of a document; its virtual finish time is the source's tokens up to its end, divided by the
source's target. All packets are range-sorted by that time and the sorted list is cut at the total budget: what lies
before the cut is taken, of the packet on it the words that are left. As times are scaled by the targets, each source
has its target at the cut, to a packet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, ranged, with_offsets

#: Documents of one source that one task sums up; larger sources are split by ranges of the shuffle key.
PART_ROWS = 200_000
#: Words of a packet: how far a source may end from its target.
PACKET = 128


def word_count(text: str) -> Column:
    """Number of runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(id_col: str) -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target, rank) from (source, size) rows, one per source.

    Sources by code point, null last, take the weights in turn. They share `share` times all sizes; a target stops at
    `epochs` times its source's size and the excess goes to the others by weight until none is above. Sorted by
    epochs * size / weight, the sources that stop are a prefix: the first level at which the next one isn't reached.
    Both orders are ranges with offsets, so that a source for every web site is no more than one task holds.
    """
    by_name = [F.col("source").asc_nulls_last()]
    s, all_sizes = with_offsets(ranged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), by_name, "sources"), {"ranks": F.lit(1), "words": F.col("source_size")})
    s = s.withColumn("rank", F.col("ranks") + F.row_number().over(Window.partitionBy("part").orderBy(*by_name)) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    s = s.select("source", "source_size", "rank", "w", (F.col("source_size") * epochs).alias("cap"))
    by_level = [F.col("cap") / F.col("w"), F.col("rank")]
    s, total = with_offsets(ranged(s, by_level, "levels"), {"capped": F.col("cap"), "used": F.col("w")})
    before = Window.partitionBy("part").orderBy(*by_level).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.col("capped") + F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("wleft", total["used"] - F.col("used") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", (F.lit(float(all_sizes["words"])) * share - F.col("capped")) / F.col("wleft"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("capped").alias("o"), F.col("level").alias("l")))
    first = s.agg(F.min(fits).alias("f")).first().f
    cap = F.col("cap").cast("double")
    target = cap if first is None else F.least(cap, F.lit(first.l) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"), "rank")


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, row: Column | None = None) -> DataFrame:
    """(id, size, source_size, target, taken, virtual_finish) of every document, range-sorted by virtual_finish.

    taken counts the words the mix takes of a document over all passes, as the cut at the total budget (`share`
    times all words, rounded down) leaves them. virtual_finish is the time of its end in the first pass. A null source is a source
    of its own, sorted last; null or empty texts have size 0 and take 0; ties in the shuffle are broken by id and
    size, so reruns agree; no rows give no rows. Only the named columns are read. row, where given, names a row
    (row_name): it breaks further ties and is returned as a last column `row`.
    """
    names = [] if row is None else ["row"]
    narrow = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), shuffle_key(id_col).alias("key"), *([] if row is None else [row.alias("row")]))
    d = materialize(narrow, "mix")
    per = d.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    most = per.agg(F.max("n")).first()[0] or 0
    parts = max(1, min(65536, 1 << max(0, (-(-most // PART_ROWS) - 1).bit_length())))
    slice_of = F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * parts / 65536).cast("int")
    d = d.withColumn("slice", slice_of)
    # a table of its own: its rows meet the documents twice
    goal = materialize(source_targets(per, weights, share, epochs), "targets")
    sums = d.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("s"), F.col("slice").alias("p"), F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("base"))
    base = base.join(goal.withColumnRenamed("source", "g"), F.col("s").eqNullSafe(F.col("g"))).drop("g")
    inside = Window.partitionBy("source", "slice").orderBy("key", "id", "size", *names).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("size").over(inside))
    d = d.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("p")))
    d = d.select("id", "size", "source_size", "target", "rank", (F.col("base") + F.col("upto")).alias("upto"), F.monotonically_increasing_id().alias("n"), *names)
    d = materialize(d, "queues")
    words = goal.agg(F.sum("source_size")).first()[0] or 0
    budget = int(min(words * share, words * epochs))
    taken = truncated(d.where("size > 0").select("n", "size", "source_size", "target", "rank", "upto"), budget, epochs)
    time = F.when(F.col("target") > 0, F.col("upto") / F.col("target")).otherwise(F.lit(0.0))
    out = d.join(taken, "n", "left")
    out = out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), time.alias("virtual_finish"), *names)
    return out.orderBy("virtual_finish", id_col)


def truncated(queues: DataFrame, budget: int, epochs: int) -> DataFrame:
    """(n, taken) of the rows of which the budget takes some: all packets, sorted by finish time, up to the budget.

    Only the range that the cut falls in is put in order; of those before it everything is taken.
    """
    packets = queues.withColumn("pass", F.explode(F.array(*[F.lit(k).cast("long") for k in range(epochs)])))
    packets = packets.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PACKET).cast("long"))))
    words = F.least(F.col("size") - F.col("at"), F.lit(PACKET)).cast("long")
    end = F.col("pass") * F.col("source_size") + F.col("upto") - F.col("size") + F.col("at") + words
    packets = packets.select("n", "rank", words.alias("words"), end.alias("end"), (end / F.col("target")).alias("finish"))
    order = [F.col(c) for c in ("finish", "rank", "end")]
    sorted_ = ranged(packets, order, "packets")
    per = sorted(sorted_.groupBy("part").agg(F.sum("words").alias("w")).collect(), key=lambda r: r.part)
    done, cut = 0, -1
    for r in per:
        cut = r.part
        if done + r.w >= budget:
            break
        done += r.w
    before = F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("words") + done
    edge = sorted_.where(F.col("part") == cut).withColumn("taken", F.least(F.greatest(F.lit(budget) - before, F.lit(0)), F.col("words")))
    whole = sorted_.where(F.col("part") < cut).select("n", F.col("words").alias("taken"))
    out = materialize(whole.union(edge.where("taken > 0").select("n", "taken")).groupBy("n").agg(F.sum("taken").alias("taken")), "taken")
    discard(sorted_)
    return out


def oracle_sql(weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> str:
    """DuckDB SQL of mix_documents over `documents`."""
    w = ", ".join(map(str, weights))
    passes = ", ".join(map(str, range(epochs)))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), c AS (
  SELECT *, [{w}][rank % {len(weights)} + 1] AS w, source_size * {epochs} AS cap FROM s
), l AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS wleft,
    (sum(source_size) OVER ())::DOUBLE * {share} AS budget FROM c
), f AS (
  SELECT *, (budget - capped) / wleft AS level FROM l
), a AS (
  SELECT arg_min(level, capped) AS level_at FROM f WHERE level <= cap / w
), g AS (
  SELECT source, source_size, rank, CASE WHEN level_at IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level_at * w) END AS target FROM f, a
), q AS (
  SELECT n, d.doc_id, size, source_size, target, rank, sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), p AS (
  SELECT n, rank, target, least(size - start, {PACKET}) AS words, pass * source_size + upto - size + start + least(size - start, {PACKET}) AS fin
  FROM (SELECT *, unnest(range(0, size, {PACKET})) AS start FROM (SELECT *, unnest([{passes}]) AS pass FROM q))
), o AS (
  SELECT n, words, sum(words) OVER (ORDER BY fin / target, rank, fin ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM p
), t AS (
  SELECT n, sum(least(greatest((SELECT least(floor(sum(source_size)::DOUBLE * {share}), sum(source_size) * {epochs})::BIGINT FROM g) - (upto - words), 0), words))::BIGINT AS taken FROM o GROUP BY n
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, CASE WHEN target > 0 THEN upto / target ELSE 0 END AS virtual_finish FROM q LEFT JOIN t USING (n)"""
