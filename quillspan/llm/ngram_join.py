"""Set-similarity join of documents over word n-grams, by rare-first prefix filtering.

1. Equal sets collapse: a document's class is (64-bit digest, size) of its n-gram set; later steps see one row a class.
2. Each n-gram's document frequency is counted over all classes. Map tasks send their n-grams, 8 bytes each, in blobs
   routed by hash range; a reducer keeps those that at least two classes hold (all others can link nothing). Hot
   n-grams, found while the classes are made, need no count: they are the last of any order and go straight to their
   classes, so that no reducer gathers them.
3. A class orders its n-grams rare first (frequency, then hash). Two sets of Jaccard similarity >= t share at least
   one of their first n - ceil(t n) + 1; classes whose unshared n-grams fill that prefix drop out.
4. Prefix n-grams are joined with the length and positional filters. Hot n-grams are split into blocks, families of
   classes that share many into salted parts.
5. Candidate pairs, each once, meet the two lists of shared n-grams in cells of bounded size; a suffix filter (counts
   by hash range bound the overlap) precedes the exact overlap.

N-grams are compared by 64-bit hashes and sets by a 64-bit digest and their size: among 1e11 different documents a few
pairs of sets of one size may share a digest, and a pair's overlap is off by one with chance |a| |b| / 2^64.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_cells, cell_pairs, connected_components, discard, materialize, mix64, partitions, reread, shingle_sets

_U = np.uint64
#: Postings that a reducer of step 2 holds, and that a map task gathers before it sends.
REDUCE = 2_500_000
FLUSH = 1_500_000
#: Classes that hold an n-gram within one such gathering, from which it is reported; and reported classes in all, or a
#: millionth of all n-grams if that is more, from which it is hot (so at most a million n-grams, 8 MB, are hot).
LOCAL, HOT = 16, 250_000
#: Lists of n-grams on the two sides of a verification cell, and the n-grams that they may hold together.
LEFT, RIGHT = 512, 4096
LEFT_GRAMS, RIGHT_GRAMS = 2_000_000, 8_000_000
#: Rows of one family in step 4 that go to one task; larger families are salted by n-gram.
FAMILY = 200_000
_LAST = np.uint32(2**32 - 1)


def _class(s: np.ndarray) -> int:
    """Digest of a set, as a signed 64-bit number."""
    return int((mix64(s ^ _U(0x5851F42D4C957F2D))).sum(dtype=_U).astype(np.int64)) if len(s) else 0


def _classes(n: int):
    """(id, class, size) of each document; and rows (null id, n-gram, classes) of n-grams often met in this task."""

    def report(kind, sets: list[np.ndarray]) -> Iterator:
        import pyarrow as pa

        h, often = np.unique(np.concatenate(sets), return_counts=True)
        h, often = h[often >= LOCAL], often[often >= LOCAL]
        if len(h):
            zero = pa.array(np.zeros(len(h), np.int64))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(h), kind), zero, zero, pa.array(h.view(np.int64)), pa.array(often.astype(np.int64))], names=["id", "c", "n", "gram", "often"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        sets: list[np.ndarray] = []
        held, kind = 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            c, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, s in shingle_sets(batch.column(1), n):
                c[k], size[k] = key = _class(s), len(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    sets.append(s)
                    held += len(s)
                    if held >= FLUSH:
                        yield from report(kind, sets)
                        sets, held = [], 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c), pa.array(size), none, none], names=["id", "c", "n", "gram", "often"])
        if sets:
            yield from report(kind, sets)

    return run


def _pack(c: np.ndarray, size: np.ndarray, count: np.ndarray, *values: np.ndarray) -> bytes:
    return struct.pack("<I", len(c)) + c.tobytes() + size.astype("<u4").tobytes() + count.astype("<u4").tobytes() + b"".join(v.tobytes() for v in values)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Class and size of each n-gram, the n-grams, and where the blob goes on."""
    (k,) = struct.unpack_from("<I", blob)
    c, size, count = np.frombuffer(blob, np.int64, k, 4), np.frombuffer(blob, "<u4", k, 4 + 8 * k), np.frombuffer(blob, "<u4", k, 4 + 12 * k)
    m = int(count.sum())
    return np.repeat(c, count), np.repeat(size, count), np.frombuffer(blob, np.uint64, m, 4 + 16 * k), 4 + 16 * k + 8 * m


def _postings(n: int, parts: int, hot: np.ndarray):
    """Blobs of (part, classes with sizes and counts, n-grams) of the classes new to this task; hot n-grams apart, their
    part being any."""

    def send(sets: list[np.ndarray], cls: list[int]) -> Iterator:
        import pyarrow as pa

        sizes = np.array([len(s) for s in sets])
        h, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        part = (((h >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
        c = np.array(cls, np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            is_hot = hot[at] == h
            # behind the ordinary parts, by class
            part[is_hot] = parts + ((mix64(c.astype(_U)) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)[own[is_hot]]
        order = np.argsort(part, kind="stable")
        h, own, part = h[order], own[order], part[order]
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(edge, np.r_[edge[1:], len(part)], strict=True):
            rows, count = np.unique(own[a:b], return_counts=True)
            p = int(part[a])
            columns = [pa.array([p % parts], pa.int32()), pa.array([p >= parts]), pa.array([_pack(c[rows], sizes[rows], count, h[a:b])], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "hot", "blob"])

    def run(batches: Iterator) -> Iterator:
        seen: set[tuple[int, int]] = set()
        sets: list[np.ndarray] = []
        cls: list[int] = []
        held = 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), n):
                if len(s) and (key := (_class(s), len(s))) not in seen:
                    seen.add(key)
                    sets.append(s)
                    cls.append(key[0])
                    held += len(s)
                    if held >= FLUSH:
                        yield from send(sets, cls)
                        sets, cls, held = [], [], 0
        if sets:
            yield from send(sets, cls)

    return run


def _shared(groups: int):
    """n-grams of one part that two classes hold, with their frequency, and hot ones, in blobs routed by class."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for is_hot, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found[is_hot].append(_unpack(blob)[:3])
        out = []
        if found[False]:
            c, n, h = (np.concatenate(x) for x in zip(*found.pop(False), strict=True))
            order = np.argsort(h)
            s = h[order]
            same = s[1:] == s[:-1]
            order = order[np.r_[False, same] | np.r_[same, False]]
            order = order[np.lexsort((n[order], c[order], h[order]))]
            h, c, n = h[order], c[order], n[order]
            if len(h):
                new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])]
                h, c, n = h[new], c[new], n[new]
                start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                df = np.diff(np.r_[start, len(h)])
                df = np.repeat(df, df)
                keep = df > 1
                out.append((c[keep], n[keep], h[keep], df[keep].astype(np.uint32)))
        if found[True]:
            c, n, h = (np.concatenate(x) for x in zip(*found.pop(True), strict=True))
            order = np.lexsort((h, n, c))  # a class that several tasks met is sent by each of them
            c, n, h = c[order], n[order], h[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])]
            out.append((c[new], n[new], h[new], np.full(int(new.sum()), _LAST)))
        if not out:
            return
        c, n, h, df = (np.concatenate(x) for x in zip(*out, strict=True))
        del out
        to = ((mix64(c.astype(_U)) >> _U(32)) * _U(groups)) >> _U(32)
        order = np.lexsort((n, c, to))
        c, n, h, df, to = c[order], n[order], h[order], df[order], to[order]
        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else []
        for a, b in zip(cut, np.r_[cut[1:], len(to)] if len(to) else [], strict=True):
            edge = a + np.flatnonzero(np.r_[True, (c[a + 1 : b] != c[a : b - 1]) | (n[a + 1 : b] != n[a : b - 1])])
            blob = _pack(c[edge], n[edge], np.diff(np.r_[edge, b]), h[a:b], df[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([int(to[a])], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

    return run


def _prefixes(num: int, den: int):
    """Rows of the classes that can still link: their shared n-grams (sorted) and the shared part of their prefix."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hs, cs, ns, fs = [], [], [], []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                c, size, h, at = _unpack(blob)
                hs.append(h)
                fs.append(np.frombuffer(blob, np.uint32, len(h), at))
                cs.append(c)
                ns.append(size)
        if not hs:
            return
        h, c, n, df = np.concatenate(hs), np.concatenate(cs), np.concatenate(ns).astype(np.int64), np.concatenate(fs)
        del hs, cs, ns, fs
        order = np.lexsort((n, c))
        edge = np.flatnonzero(np.r_[True, (c[order][1:] != c[order][:-1]) | (n[order][1:] != n[order][:-1])])
        ends = np.r_[edge[1:], len(order)]
        size = n[order[edge]]
        fits = (ends - edge) >= -(-num * size // den)
        rows: list[tuple] = []
        for a, b, m in zip(edge[fits], ends[fits], size[fits], strict=True):
            o = order[a:b]
            own, length = b - a, int(m)
            p = length - -(-num * length // den) + 1
            take = p - (length - own)
            if take > 0:
                front = o[np.lexsort((h[o], df[o]))[:take]]
                rows.append((int(c[o[0]]), length, np.sort(h[o]).tobytes(), h[front].astype(np.int64), length - own))
            if len(rows) >= 1000:
                yield _prefix_batch(pa, rows)
                rows = []
        if rows:
            yield _prefix_batch(pa, rows)

    return run


def _prefix_batch(pa, rows):
    c, n, shared, front, free = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.binary()), pa.array(front, pa.list_(pa.int64())), pa.array(free, pa.int64())], names=["c", "n", "shared", "front", "free"]
    )


def _candidates(num: int, den: int):
    """Pairs of classes that share a prefix n-gram inside one cell and pass the length and positional filters."""

    def flush(found: list[np.ndarray]) -> pd.DataFrame:
        p = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame(p, columns=["a", "an", "b", "bn"])

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows, sorted by cell, in pieces that end where a cell does."""
        rest: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = tuple(b[k].iloc[-1] for k in ("token", "bi", "bj"))
            at = int(((b["token"] == last[0]) & (b["bi"] == last[1]) & (b["bj"] == last[2])).to_numpy().argmax())
            if at or not rest or tuple(rest[-1][k].iloc[-1] for k in ("token", "bi", "bj")) != last:
                yield pd.concat([*rest, b.iloc[:at]], ignore_index=True)
                rest = []
            rest.append(b.iloc[at:])
        if rest:
            yield pd.concat(rest, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = []
        held = 0
        for rows in cells(batches):
            token, bi, bj, block = (rows[k].to_numpy() for k in ("token", "bi", "bj", "block"))
            c, n, pos = (rows[k].to_numpy() for k in ("c", "n", "pos"))
            edge = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]) if len(rows) else np.zeros(0, np.int64)
            for s, e in zip(edge, np.r_[edge[1:], len(rows)][: len(edge)], strict=True):
                if e - s < 2:
                    continue
                x, y = cell_pairs(block[s:e], bi[s], bj[s])
                x, y = x + s, y + s
                lo, hi = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                # overlap needed for Jaccard >= num / den, and the most that is left from this n-gram on
                need = -(-num * (lo + hi) // (num + den))
                left = np.minimum(n[x] - pos[x], n[y] - pos[y])
                ok = (den * lo >= num * hi) & (left >= need)
                x, y = x[ok], y[ok]
                swap = (c[x] > c[y]) | ((c[x] == c[y]) & (n[x] > n[y]))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                if len(x):
                    found.append(np.stack([c[x], n[x], c[y], n[y]], 1))
                    held += len(x)
                if held > 1_500_000:
                    out = flush(found)
                    found, held = [out.to_numpy()], len(out)
                    if held > 1_000_000:
                        yield out
                        found, held = [], 0
        if found:
            yield flush(found)

    return run


def _verify(num: int, den: int):
    """Exact overlap of the pairs of one cell, from the lists of its members."""

    def run(key, pairs: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        where = {k: i for i, k in enumerate(zip(lists["c"], lists["n"], strict=True))}
        tokens = [np.frombuffer(t, np.uint64) for t in lists["shared"]]
        a = np.array([where[k] for k in zip(pairs["a"], pairs["an"], strict=True)], np.int64)
        b = np.array([where[k] for k in zip(pairs["b"], pairs["bn"], strict=True)], np.int64)
        need = -(-num * (pairs["an"].to_numpy() + pairs["bn"].to_numpy()) // (num + den))
        hist = np.stack([np.bincount((t & _U(31)).astype(np.int64), minlength=32) for t in tokens])
        good = np.zeros(len(a), bool)
        for s in range(0, len(a), 65536):
            e = s + 65536
            good[s:e] = np.minimum(hist[a[s:e]], hist[b[s:e]]).sum(1) >= need[s:e]
        vocab, flat = np.unique(np.concatenate(tokens), return_inverse=True)
        at = np.r_[0, np.cumsum([len(t) for t in tokens])]
        mark = np.zeros(len(vocab), bool)
        order = np.flatnonzero(good)
        if not len(order):
            return pairs.loc[good, ["a", "an", "b", "bn"]]
        order = order[np.argsort(a[order], kind="stable")]
        edge = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1]])
        for s, e in zip(edge, np.r_[edge[1:], len(order)], strict=True):
            own = flat[at[a[order[s]]] : at[a[order[s]] + 1]]
            mark[own] = True
            for k in order[s:e]:
                good[k] = np.count_nonzero(mark[flat[at[b[k]] : at[b[k] + 1]]]) >= need[k]
            mark[own] = False
        return pairs.loc[good, ["a", "an", "b", "bn"]]

    return run


def similar_classes(docs: DataFrame, total: int, hot: np.ndarray, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Linked pairs (a, an, b, bn) of classes of the documents (one column, text); total: n-grams over all documents;
    hot: n-grams that no reducer is to count, sorted."""
    spark = docs.sparkSession
    parts = partitions(spark, total, REDUCE)
    blobs = docs.mapInArrow(_postings(n, parts, hot), "part int, hot boolean, blob binary").repartitionById(parts, "part")
    blobs = blobs.mapInArrow(_shared(parts), "part int, blob binary").repartitionById(parts, "part")
    lists = materialize(blobs.mapInArrow(_prefixes(num, den), "c long, n long, shared binary, front array<long>, free long"), "lists")
    rows = lists.select("c", "n", F.posexplode("front").alias("at", "token"), "free").select("token", "c", "n", (F.col("free") + F.col("at")).alias("pos"))
    per = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("anchor")).where("size > 1")
    # the same classes share many n-grams: cells of one anchor go to few tasks, which drop most repeats of a pair
    load = per.groupBy("anchor").agg(F.ceil(F.sum("size") / FAMILY).alias("salts"))
    per = per.join(load, "anchor").withColumn("salt", F.pmod(F.xxhash64("token"), F.col("salts"))).drop("salts")
    cells = block_cells(rows.join(per, "token"), "size", "c").select("token", "c", "n", "pos", "anchor", "salt", "block", "bi", "bj")
    cells = cells.repartition(parts, "anchor", "salt", "bi", "bj").sortWithinPartitions("token", "bi", "bj")
    pairs = cells.mapInPandas(_candidates(num, den), "a long, an long, b long, bn long").distinct()
    pairs = materialize(pairs, "pairs")
    both = pairs.select("a", "an", "b", "bn").union(pairs.select("b", "bn", "a", "an"))
    anchor = both.groupBy("a", "an").agg(F.least(F.col("a"), F.min("b")).alias("g"))
    pairs2 = pairs.join(anchor, ["a", "an"])
    wide = pairs2.groupBy("g").agg(F.approx_count_distinct("a").alias("na"), F.approx_count_distinct("b").alias("nb"), F.max("an").alias("ma"), F.max("bn").alias("mb"))
    pairs2 = pairs2.join(wide, "g")
    # a cell is bounded by its lists and by the n-grams that they hold
    split = lambda c, m, top, k, grams: F.pmod(F.xxhash64(c), F.ceil(F.greatest(F.col(m) / k, F.col(m) * F.col(top) / grams))).cast("int")
    pairs2 = pairs2.select("g", split("a", "na", "ma", LEFT, LEFT_GRAMS).alias("i"), split("b", "nb", "mb", RIGHT, RIGHT_GRAMS).alias("j"), "a", "an", "b", "bn")
    pairs2 = materialize(pairs2, "cells")
    again = reread(pairs2)
    members = again.select("g", "i", "j", F.col("a").alias("c"), F.col("an").alias("n")).union(again.select("g", "i", "j", "b", "bn")).distinct()
    members = members.join(lists.select("c", "n", "shared"), ["c", "n"])
    key = ["g", "i", "j"]
    links = pairs2.groupBy(*key).cogroup(members.groupBy(*key)).applyInPandas(_verify(num, den), "a long, an long, b long, bn long")
    links = materialize(links, "links")
    discard(lists, pairs, pairs2)
    return links


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(id, n_shingles, n_similar, component_id) of every row of df.

    Two rows link when den * |intersection| >= num * |union| of their sets of n-word shingles (A-Z lower-cased, words
    between ASCII white space; with fewer words the whole sequence is the one shingle). component_id is the least id
    reachable by links, the row's own included (null ids are passed over). Null, empty and wordless texts have no
    shingle, link with nothing and are their own component. Repeated rows and equal ids are documents of their own
    and count as links. An empty table gives an empty result; only the two named columns are read.
    """
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(df.dtypes)[id_col]
    made = materialize(narrow.mapInArrow(_classes(n), f"id {kind}, c long, n long, gram long, often long"), "classes")
    docs = made.where("gram is null").select("id", "c", "n")
    total = docs.agg(F.sum("n")).first()[0] or 0
    hot = made.where("gram is not null").groupBy("gram").agg(F.sum("often").alias("often")).where(F.col("often") >= max(HOT, total // 1_000_000))
    hot = np.sort(np.array([r.gram for r in hot.select("gram").collect()], np.int64).view(_U))
    links = similar_classes(narrow.select("text"), total, hot, n, num, den)
    classes = docs.where("n > 0").groupBy("c", "n").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    sides = links.select("a", "an", "b", "bn").union(links.select("b", "bn", "a", "an"))
    weight = classes.select(F.col("c").alias("b"), F.col("n").alias("bn"), "copies")
    near = sides.join(weight, ["b", "bn"]).groupBy(F.col("a").alias("c"), F.col("an").alias("n")).agg(F.sum("copies").alias("near"))
    # nodes are digests of (c, n); equal ids and null ids therefore cannot join groups
    node = lambda c, m: F.xxhash64(F.col(c), F.col(m))
    roots = connected_components(links.select(node("a", "an").alias("u"), node("b", "bn").alias("v")))
    classes = classes.join(near, ["c", "n"], "left").withColumn("node", node("c", "n")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = materialize(classes.where("near is not null or copies > 1"), "linked")
    best = classes.groupBy("root").agg(F.min("least").alias("best"))
    info = classes.join(best, "root").select("c", "n", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("similar"), "best")
    out = docs.join(info, ["c", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("best", "id").alias("component_id"))


def oracle_sql() -> str:
    """DuckDB SQL of ngram_jaccard_join over `documents`: all pairs that share a shingle, then reachability."""
    return r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN [array_to_string(t[i:i + 4], ' ') for i in range(1, len(t) - 3)] WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), hot AS (
  SELECT s FROM g GROUP BY s HAVING count(*) > 1
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM (SELECT * FROM g SEMI JOIN hot USING (s)) a JOIN (SELECT * FROM g SEMI JOIN hot USING (s)) b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 80 * (x.n + y.n - common)
), r AS (
  SELECT DISTINCT u, u AS v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v
), c AS (
  SELECT u, min(v) AS component_id FROM r GROUP BY u
), k AS (
  SELECT u, count(*) AS n_similar FROM l GROUP BY u
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(n_similar, 0) AS n_similar, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.u = w.doc_id LEFT JOIN c ON c.u = w.doc_id"""
