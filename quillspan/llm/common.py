"""Shared pieces of the pipeline operators: scratch tables, cut points, hashing of words, linked groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, remove

#: Rows up to which an id list may be broadcast (8 bytes each in a hashed relation of about 64 MB at most).
BROADCAST_IDS = 500_000

_U = np.uint64


def reread(table: DataFrame) -> DataFrame:
    """The same scratch table as a new DataFrame, so that both may meet in one plan."""
    return table.sparkSession.read.schema(table.schema).parquet(table._scratch_path)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            remove(t.sparkSession, path)


def partitions(spark: SparkSession, units: int, per_partition: int) -> int:
    """Partitions for so many units of work: the session's number, or more where the data need more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // per_partition))


def anti_join_ids(df: DataFrame, key: str, drop: DataFrame) -> DataFrame:
    """df without the rows whose key is in drop (one column of that name); broadcast only behind a count."""
    small = drop.count() <= BROADCAST_IDS
    return df.join(F.broadcast(drop) if small else drop, key, "left_anti")


def row_name(df: DataFrame) -> Column:
    """128 hash bits over all columns of a row, nulls told apart from values: only rows equal throughout share a name."""
    cells = [c for name in df.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    return F.concat_ws(":", F.xxhash64(*cells), F.xxhash64(F.lit("again"), *cells))


def ranged(df: DataFrame, order: list, name: str, parts: int | None = None) -> DataFrame:
    """df as a scratch table in ranges of `order`, numbered by a column `part`: range k lies before range k + 1, rows
    inside a range have no order yet. With prefix sums over the few ranges, no task ever orders more than one range."""
    df = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return materialize(df.withColumn("part", F.spark_partition_id()), name)


def with_offsets(table: DataFrame, sums: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """A ranged table with, for each named sum, a column of that name: the sum over all ranges before the row's own;
    and the total of each. The driver sees one row a range."""
    got = sorted(table.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).collect(), key=lambda r: r.part)
    total = dict.fromkeys(sums, 0)
    rows = []
    for r in got:
        rows.append((r.part, *total.values()))
        total = {n: total[n] + (r[n] or 0) for n in sums}
    shape = "part int, " + ", ".join(f"{n} long" for n in sums)
    return table.join(F.broadcast(table.sparkSession.createDataFrame(rows, shape)), "part"), total


# ---------------------------------------------------------------- words and shingles

_rng = np.random.default_rng(20240607)
_TAB = _rng.integers(0, 2**64, 256, dtype=_U, endpoint=False)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_COEF = _rng.integers(0, 2**63, 64, dtype=_U) * _U(2) + _U(1)
_R = 0x9E3779B97F4A7C15 | 5
_RINV = pow(_R, -1, 2**64)
_CHUNK = 1 << 19
#: Bytes from which a word is hashed by a cryptographic digest: a polynomial modulo a power of two, as the shorter ones
#: get, has equal values for some texts of 1024 bytes and more whatever its base.
_LONG = 256


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_pow: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, _CHUNK + 1)
        _pow[:] = [_powers(_R, size), _powers(_RINV, size)]
    return _pow[0], _pow[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def arrow_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its offsets (nulls are empty)."""
    import pyarrow as pa

    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and off[-1] else np.zeros(0, np.uint8)
    return data, off


def word_hashes(data: np.ndarray, off: np.ndarray, split: np.ndarray | None = None, prefix: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash each word of each text, a block of texts at a time.

    Yields (first text, end text, word hashes, first word of each text (+ end), hashes of word starts).
    A-Z are hashed as a-z. split marks the bytes between words (default: ASCII white space). With prefix, the last
    item hashes each longer word's first so many bytes (0 for others).
    """
    split = _SPACE if split is None else split
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + _CHUNK, side="right")) - 1
        j = min(max(j, i + 1), n)
        a, b = int(off[i]), int(off[j])
        buf = data[a:b]
        starts = off[i : j + 1] - a
        if b == a:
            yield i, j, np.zeros(0, _U), np.zeros(j - i + 1, np.int64), np.zeros(0, _U)
            i = j
            continue
        inside = ~split[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        full = starts[:-1][np.diff(starts) > 0]
        first[full] = inside[full]
        ends = starts[1:][np.diff(starts) > 0] - 1
        last[ends] = inside[ends]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _tables(len(buf) + 1)
        acc = np.zeros(len(buf) + 1, _U)
        np.cumsum(_TAB[_LOW[buf]] * up[: len(buf)], out=acc[1:])
        h = mix64((acc[e] - acc[s]) * down[s] + (e - s).astype(_U))
        for k in np.flatnonzero(e - s >= _LONG):
            h[k] = int.from_bytes(hashlib.blake2b(_LOW[buf[s[k] : e[k]]].tobytes(), digest_size=8).digest(), "little")
        start = np.zeros(0, _U)
        if prefix:
            cut = np.minimum(s + prefix, e)
            start = np.where(e > cut, mix64((acc[cut] - acc[s]) * down[s] + _U(255)), _U(0))
        yield i, j, h, np.searchsorted(s, starts), start
        i = j


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    acc = words[:m] * _COEF[0]
    for k in range(1, n):
        acc = acc + words[k : m + k] * _COEF[k]
    return mix64(acc)


def short_hash(words: np.ndarray) -> np.ndarray:
    """Hash of a whole sequence shorter than a shingle, as a set of one."""
    return mix64((words * _COEF[: len(words)]).sum(dtype=_U, keepdims=True) + np.array([len(words)], _U) * _U(0xD6E8FEB86659FD93))


def shingle_sets(col, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of an Arrow column its number and the sorted distinct n-word shingles, as 64-bit hashes."""
    data, off = arrow_bytes(col)
    for i, j, words, at, _ in word_hashes(data, off):
        grams = shingle_hashes(words, n)
        for k in range(i, j):
            a, b = int(at[k - i]), int(at[k - i + 1])
            if b - a >= n:
                yield k, np.unique(grams[a : b - n + 1])
            else:
                yield k, short_hash(words[a:b]) if b > a else np.zeros(0, _U)


# ---------------------------------------------------------------- groups

#: Members of a block: larger groups are compared block against block, each pair of blocks a task of its own.
BLOCK = 2048


def block_cells(df: DataFrame, size: str, member: str, block: int = BLOCK) -> DataFrame:
    """Split a group into blocks by a hash of its member and send each row to every pair of blocks it belongs to.

    Adds block (of the row) and bi <= bj (the pair); a group of at most `block` members stays one cell (0, 0).
    """
    nb = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    df = df.withColumn("nb", nb).withColumn("block", F.pmod(F.xxhash64(member), F.col("nb")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return df.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "nb")


def cell_pairs(block: np.ndarray, bi: int, bj: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that a cell compares: all inside one block, or those across two."""
    if bi == bj:
        return np.triu_indices(len(block), 1)
    x, y = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    return np.repeat(x, len(y)), np.tile(y, len(x))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of one partition reduced to a forest: each node to the least node it hangs together with here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for pdf in batches:
        for a, b in zip(pdf["u"].to_numpy(), pdf["v"].to_numpy(), strict=True):
            x, y = root(int(a)), root(int(b))
            if x != y:
                x, y = max(x, y), min(x, y)
                parent[x] = y
                parent.setdefault(y, y)
        if len(parent) > 2_000_000:
            yield pd.DataFrame([(k, root(k)) for k in parent if root(k) != k], columns=["u", "v"], dtype="int64")
            parent.clear()
    if parent:
        yield pd.DataFrame([(k, r) for k in list(parent) if (r := root(k)) != k], columns=["u", "v"], dtype="int64")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with an edge: root is the least node reachable.

    edges: two long columns u and v, any orientation, loops and repeats allowed. Each partition first keeps only a
    forest of its edges; alternating large-star and small-star rounds then end in stars after few rounds. Every
    round is a written table, so a lost executor repeats one round at most. The joins look up one row a node, so a hub
    is skewed on one side only, which adaptive execution splits.
    """
    e = edges.where("u <> v").mapInPandas(_forest, "u long, v long")
    e = materialize(e.distinct(), "cc")
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        seen = tuple(mark)
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = materialize(small.union(down.select("u", "m")).distinct(), "cc")
        discard(e)
        e = step
