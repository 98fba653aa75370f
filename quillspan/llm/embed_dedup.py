"""Near-duplicate embeddings by Euclidean p-stable hashing.

A vector, scaled to length 1, is projected on Gaussian directions, shifted and cut into steps of a fixed width; k steps
make a bucket, several tables of buckets make it likely that near vectors meet once. Pairs that meet are compared by
their exact cosine. Equal vectors collapse first, hot buckets are split into blocks, and a pair is compared only in
the first table in which it meets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_cells, connected_components, discard, materialize, mix64, partitions

WIDTH = 2.0
RECALL = 0.99
_U = np.uint64


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for two vectors at that distance."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(count: int, threshold: float, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """Projections a table and tables: orthogonal vectors should share a bucket with under one other of `count` vectors
    in two tables, and a pair at the threshold should meet somewhere with chance `recall`."""
    k = max(4, math.ceil(math.log(2 * max(count, 2)) / -math.log(collision(math.sqrt(2), width))))
    p = collision(math.sqrt(2 - 2 * threshold), width) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - p))


def projections(dim: int, k: int, tables: int, seed: int = 11, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, width, k * tables)


def bucket_keys(x: np.ndarray, label: np.ndarray, k: int, tables: int, width: float = WIDTH) -> np.ndarray:
    """(rows, tables) bucket hashes of unit vectors of one dimension, apart for each label and dimension."""
    a, b = projections(x.shape[1], k, tables, width=width)
    steps = np.floor((x @ a + b) / width).astype(np.int64).astype(_U).reshape(len(x), tables, k)
    h = np.broadcast_to(mix64(label.astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15) + _U(x.shape[1]))[:, None], (len(x), tables)) + np.arange(tables, dtype=_U)
    for j in range(k):
        h = mix64(h + steps[:, :, j] * _U(0xD6E8FEB86659FD93))
    return h


def _rows(column) -> list[np.ndarray | None]:
    """Each usable vector in double precision, else None."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        x = None
        if v and None not in v:
            x = np.asarray(v, np.float64) + 0.0
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0 or not np.isfinite(x).all():
                x = None
        out.append(x)
    return out


def _digests(kind: str):
    """Class (digest of label and vector) and bytes of each usable vector, in the precision of its column."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            labels = batch.column(2).to_pylist()
            xs = [x if y is not None else None for x, y in zip(_rows(batch.column(1)), labels, strict=True)]
            data = [None if x is None else x.astype(kind).tobytes() for x in xs]
            c = [None if x is None else int.from_bytes(hashlib.blake2b(x, digest_size=8, salt=y.to_bytes(16, "little", signed=True)).digest(), "little", signed=True) for x, y in zip(data, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.int64()), pa.array(c, pa.int64()), pa.array(data, pa.binary())], names=["id", "label", "c", "x"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(k: int, tables: int, dtype: str):
    """Bucket keys of each vector; and their upper halves, by which later tables know the pairs of earlier ones."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data = batch.column(2).to_pylist()
            label = np.array(batch.column(1).to_pylist(), np.int64)
            out: list = [None] * len(data)
            for size in sorted({len(d) for d in data}):
                rows = [i for i, d in enumerate(data) if len(d) == size]
                x = _unit(np.stack([np.frombuffer(data[i], dtype).astype(np.float64) for i in rows]))
                for i, h in zip(rows, bucket_keys(x, label[rows], k, tables), strict=True):
                    out[i] = h
            half = [(h >> _U(32)).astype("<u4").tobytes() for h in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.astype(np.int64) for h in out], pa.list_(pa.int64())), pa.array(half, pa.binary()), batch.column(2)], names=["c", "keys", "half", "x"])

    return run


def _compare(threshold: float, dtype: str):
    """Pairs of a cell with cosine >= threshold that meet in no earlier table (by 32 bits of the keys: a pair that meets
    in one table only is taken for an earlier one's with chance tables / 2^32)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        rows = rows.sort_values(["key", "bi", "bj", "c"], kind="stable", ignore_index=True)
        key, bi, bj, block, c, t = (rows[n].to_numpy() for n in ("key", "bi", "bj", "block", "c", "t"))
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        for s, e in zip(edge, np.r_[edge[1:], len(rows)], strict=True):
            if e - s < 2:
                continue
            x = np.stack([np.frombuffer(v, dtype) for v in rows["x"].iloc[s:e]]).astype(np.float64)
            x = _unit(x)
            keys = np.stack([np.frombuffer(v, "<u4") for v in rows["half"].iloc[s:e]])[:, : t[s]]
            own = block[s:e]
            left, right = np.flatnonzero(own == bi[s]), np.flatnonzero(own == bj[s])
            for at in range(0, len(left), 512):
                part = left[at : at + 512]
                i, j = np.nonzero(x[part] @ x[right].T >= threshold - 1e-9)
                i, j = part[i], right[j]
                ok = (c[s + i] < c[s + j]) if bi[s] == bj[s] else np.ones(len(i), bool)
                i, j = i[ok], j[ok]
                if len(i):
                    ok = ((x[i] * x[j]).sum(1) >= threshold) & ~(keys[i] == keys[j]).any(1)
                    a, b = c[s + i[ok]], c[s + j[ok]]
                    yield pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b)})

    return run


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.93, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Vectors of one label and dimension link when their cosine in double precision is >= threshold; pairs are found
    with chance >= recall each and checked exactly. Labels may have any type and are equal as Spark has it (compared
    by a 64-bit hash). Vectors that are null, empty, zero or hold null or non-finite
    parts, and those with a null label, link with nothing and are their own component. Equal vectors, repeated ids and
    repeated rows count as vectors of their own. kept is true where the id is its component's least. An empty table
    gives an empty result; only the named columns are read. label_col None compares all rows.
    """
    spark = df.sparkSession
    label = F.lit(0).cast("long") if label_col is None else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    kind = dict(df.dtypes)[id_col]
    dtype = "<f4" if dict(df.dtypes)[vector_col] == "array<float>" else "<f8"
    narrow = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"), label.alias("label"))
    vecs = materialize(narrow.mapInArrow(_digests(dtype), f"id {kind}, label long, c long, x binary"), "vectors")
    classes = vecs.where("c is not null").groupBy("c").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    classes = materialize(classes, "vclasses")
    most = classes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    k, tables = plan(most[0] or 0, threshold, recall=recall)
    hashed = materialize(classes.select("c", "label", "x").mapInArrow(_keys(k, tables, dtype), "c long, keys array<long>, half binary, x binary"), "vkeys")
    # a key tells its table as well; only rows that share one carry a vector
    rows = hashed.select("c", F.posexplode("keys").alias("t", "key"))
    sizes = hashed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    cells = block_cells(rows.join(sizes, "key"), "size", "c").join(hashed.select("c", "half", "x"), "c")
    parts = partitions(spark, (most[1] or 0) * tables, 100_000)
    links = cells.repartition(parts, "key", "bi", "bj").mapInPandas(_compare(threshold, dtype), "u long, v long")
    links = materialize(links, "vlinks")
    both = links.union(links.select("v", "u"))
    near = both.join(classes.select(F.col("c").alias("v"), "copies"), "v").groupBy(F.col("u").alias("c")).agg(F.sum("copies").alias("near"))
    roots = connected_components(links).withColumnRenamed("node", "c")
    info = classes.select("c", "copies", "least").join(near, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    best = info.groupBy("root").agg(F.min("least").alias("best"))
    info = materialize(info.join(best, "root").select("c", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n"), "best"), "vinfo")
    discard(hashed, links)
    out = vecs.select("id", "c").join(info, "c", "left")
    component = F.coalesce("best", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def oracle_sql() -> str:
    """DuckDB SQL of near_duplicate_vectors over `embeddings`: every pair of a label, then reachability."""
    return """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_aggregate(list_transform(x, lambda v: abs(v)), 'max') > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93
), r AS (
  SELECT DISTINCT u, u AS v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v
), c AS (
  SELECT u, min(v) AS component_id FROM r GROUP BY u
), k AS (
  SELECT u, count(*) AS n_links FROM l GROUP BY u
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM e LEFT JOIN k ON k.u = vec_id LEFT JOIN c ON c.u = vec_id"""
