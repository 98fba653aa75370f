"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots, the bytes of each slot are summed, and a versioned
slot-to-shard map places the slots. Rebalancing edits the map, never the hash, so only the rows of moved slots move.
The path is DataFrame functions only; the driver sees one row per slot, a constant number.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SLOTS = 4096
#: Rows of a virtual slot that one task numbers; slots with more are numbered in parts.
PART_ROWS = 250_000


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. Edits return the next version; history lists (version, slots moved)."""

    shards: tuple[int, ...]
    n_shards: int
    version: int = 1
    history: tuple[tuple[int, int], ...] = field(default=())

    @staticmethod
    def balanced(slot_bytes: list[int], n_shards: int) -> SlotMap:
        """First version: slots by falling bytes, each to the shard with the fewest bytes so far (least number on ties)."""
        heap = [(0, s) for s in range(n_shards)]
        place = [0] * len(slot_bytes)
        for slot in sorted(range(len(slot_bytes)), key=lambda k: (-slot_bytes[k], k)):
            load, shard = heapq.heappop(heap)
            place[slot] = shard
            heapq.heappush(heap, (load + slot_bytes[slot], shard))
        return SlotMap(tuple(place), n_shards)

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            out[shard] += slot_bytes[slot]
        return out

    def rebalance(self, slot_bytes: list[int], n_shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
        """Next version for new byte counts or another number of shards, moving few slots.

        Slots of removed shards move first; then slots go from the fullest to the emptiest shard while that narrows
        the gap and the fullest is over the mean by more than the tolerance.
        """
        n = n_shards or self.n_shards
        place = list(self.shards)
        loads = [0] * n
        homeless = []
        for slot, shard in enumerate(place):
            if shard < n:
                loads[shard] += slot_bytes[slot]
            else:
                homeless.append(slot)
        for slot in sorted(homeless, key=lambda k: (-slot_bytes[k], k)):
            to = min(range(n), key=lambda s: (loads[s], s))
            place[slot] = to
            loads[to] += slot_bytes[slot]
        limit = (1 + tolerance) * sum(slot_bytes) / n
        for _ in range(len(place) * 2):
            top, low = max(range(n), key=lambda s: (loads[s], -s)), min(range(n), key=lambda s: (loads[s], s))
            gap = loads[top] - loads[low]
            if loads[top] <= limit:
                break
            fits = [k for k, s in enumerate(place) if s == top and 0 < slot_bytes[k] < gap]
            if not fits:
                break
            slot = min(fits, key=lambda k: (abs(gap - 2 * slot_bytes[k]), k))
            place[slot] = low
            loads[top] -= slot_bytes[slot]
            loads[low] += slot_bytes[slot]
        moved = sum(a != b for a, b in zip(place, self.shards, strict=True))
        return SlotMap(tuple(place), n, self.version + 1, (*self.history, (self.version + 1, moved)))

    def column(self, slot: str) -> Column:
        """Shard of a virtual slot, as a lookup in a constant array."""
        return F.element_at(F.expr(f"array({','.join(map(str, self.shards))})"), F.col(slot) + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map table at path (one row per version; versions are never changed)."""
        rows = json.dumps(list(self.shards)), json.dumps([list(h) for h in self.history])
        spark.range(1).select(
            F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), F.lit(rows[0]).alias("shards"), F.lit(rows[1]).alias("history")
        ).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, by default the newest."""
        df = spark.read.parquet(path)
        df = df.where(F.col("version") == version) if version else df.orderBy(F.desc("version"))
        r = df.first()
        return SlotMap(tuple(json.loads(r.shards)), r.n_shards, r.version, tuple(map(tuple, json.loads(r.history))))


def next_map(spark: SparkSession, sizes: list[int], n_shards: int, path: str | None = None) -> SlotMap:
    """Map for these bytes of slots: the newest at path, rebalanced and saved as the next version; else a first one."""
    if path is None:
        return SlotMap.balanced(sizes, n_shards)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        old = SlotMap.load(spark, path)
        if len(old.shards) != len(sizes):
            raise ValueError(f"the map at {path} has {len(old.shards)} slots, not {len(sizes)}")
        m = old.rebalance(sizes, n_shards)
    else:
        m = SlotMap.balanced(sizes, n_shards)
    m.save(spark, path)
    return m


def size_of(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def record_hash(id_col: Column, crc: Column) -> Column:
    """32 hash bits of a record: its id and the CRC of its text, so that rows that share one of them still spread."""
    key = F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("")), crc.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def digest(df: DataFrame, id_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, h) of each record, about a hundredth of the text."""
    df = df.select(F.col(id_col), size_of(text_col).alias("size"), text_crc(text_col).alias("text_crc32"))
    df = df.withColumn("h", record_hash(F.col(id_col), F.col("text_crc32")))
    return df.withColumn("virtual_slot", (F.col("h") % slots).cast("int"))


def slot_bytes(digests: DataFrame, slots: int = SLOTS) -> tuple[list[int], int]:
    """Bytes of every virtual slot, and the largest number of rows in one."""
    out, most = [0] * slots, 0
    for r in digests.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        out[r.virtual_slot] = r.b
        most = max(most, r.n)
    return out, most


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, slots: int = SLOTS, slot_map: SlotMap | None = None, map_path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) of each record, under the law `bytes`.

    slot is the record's place in its shard, gapless from 0: the rows before its virtual slot in the shard plus its
    rank inside it, counted in two levels so that no task numbers a whole shard. A null id hashes as the empty
    string, a null text has size 1 and the CRC of no bytes; equal rows share a virtual slot and take neighbouring
    places; no rows give no rows. Only the two named columns are read, so other columns may have any name.
    With map_path the newest map there is rebalanced and saved as the next version; slot_map is used as it is.
    Rows of equal text but other ids are spread on purpose: a group of copies may hold a third of all bytes, and
    together in one shard they would break the law of equal bytes.
    """
    d = materialize(digest(df, id_col, text_col, slots), "slots")
    sizes, most = slot_bytes(d, slots)
    m = slot_map or next_map(df.sparkSession, sizes, n_shards, map_path)
    parts = max(1, -(-most // PART_ROWS))
    d = d.withColumn("shard", m.column("virtual_slot")).withColumn("part", (F.floor(F.col("h") / slots) % parts).cast("int"))
    counts = d.groupBy("shard", "virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "virtual_slot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "virtual_slot", "part").orderBy("h", F.col(id_col), "text_crc32", "size"))
    d = d.withColumn("rank", rank).join(base, ["shard", "virtual_slot", "part"])
    return d.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """df with virtual_slot and shard added, and the map that placed them (map_path: see shard_documents): one narrow
    pass for the bytes, no shuffle of texts.

    Null ids and texts count as empty, as in shard_documents; repeated rows share a slot; an empty table gives an empty
    one; other columns pass as they are, but for columns of these two names, which are replaced.
    """
    sizes, _ = slot_bytes(digest(df, id_col, text_col, slots), slots)
    m = next_map(df.sparkSession, sizes, n_shards, map_path)
    slot = (record_hash(F.col(id_col), text_crc(text_col)) % slots).cast("int")
    return df.withColumn("virtual_slot", slot).withColumn("shard", m.column("virtual_slot")), m


def oracle_sql(n_shards: int = 16, slots: int = SLOTS) -> str:
    """DuckDB SQL of shard_documents over `documents` with slots of at most PART_ROWS rows: CRC-32 byte by byte from a
    table of its remainders, greedy placing of slots by recursion."""
    zeros = ", ".join(["0"] * n_shards)
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_transform(range(9), lambda x: CASE WHEN x = 0 THEN b::UBIGINT ELSE 0::UBIGINT END),
      lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384::UBIGINT, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(b))
), d0 AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents
), d1 AS (
  SELECT doc_id, length(hx) // 2 + 1 AS size, xor(4294967295::UBIGINT, list_reduce(
    list_transform(list_prepend('FFFFFFFF', regexp_extract_all(hx, '..')), lambda x: ('0x' || x)::UBIGINT),
    lambda a, x: xor(t[(xor(a & 255, x) + 1)::BIGINT], a >> 8)))::BIGINT AS text_crc32 FROM d0, crc_table
), d2 AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || text_crc32), 1, 8))::BIGINT AS h FROM d1
), s AS (
  SELECT h % {slots} AS slot, sum(size)::BIGINT AS b FROM d2 GROUP BY 1
), ranked AS (
  SELECT slot, b, row_number() OVER (ORDER BY b DESC, slot) AS k FROM s
), place(k, slot, shard, loads) AS (
  SELECT 0::BIGINT, -1::BIGINT, -1::BIGINT, [{zeros}]::BIGINT[]
  UNION ALL
  SELECT r.k, r.slot, list_position(loads, list_min(loads)) - 1,
    list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN r.b ELSE 0 END)
  FROM place p JOIN ranked r ON r.k = p.k + 1
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY h % {slots}, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard, (h % {slots})::INTEGER AS virtual_slot
FROM d2 JOIN place ON place.slot = h % {slots}"""
