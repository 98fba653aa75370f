"""Benchmark decontamination under edit distance.

Texts and items are sequences of words. The CGK random walk copies a sequence to a longer one, repeating each symbol or
moving on as a random function of step and symbol says; sequences at a small edit distance then agree in most places,
so edit distance becomes Hamming distance. A walk is started at every word of a text: its windows are the size of an
item, of items over STRETCH words the size of their stretches of so many. A band samples a few places of the walk that
lie near each other; a window that agrees with an item in a whole band is verified by exact edit distance. Several
walks, each with bands along its length, reach the target recall (see WALKS).

Walks that meet at a word go on as one, so from one block of steps to the next only the distinct walks are followed:
their number falls with the square root of the steps, which is what makes a walk from every word affordable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, mix64, word_hashes
from .toxicity import _SPLIT

_U = np.uint64
#: Edits allowed as a share of an item's words.
EDITS = 0.25
#: Words that one walk embeds, steps that it takes over them, and steps of a block, whose bands sample inside it.
STRETCH, STEPS, BLOCK = 24, 48, 8
#: Places that the bands of a block sample, by the number of places: one finds items that allow no edit, two those of
#: under eight words, three all others.
#: Items of at least so many words leave out the first block, where every walk is still on its own.
LATE = 12
BANDS = {1: ((0,),), 2: ((0, 3), (1, 4), (2, 5), (3, 6), (4, 7)), 3: ((0, 3, 6), (1, 4, 7), (0, 2, 5), (2, 4, 7))}
#: Walks for items of at most so many words: with them 0.97 of the items that have all allowed edits, and more of the
#: others, are found, as measured by `recall`; longer items have more stretches and need no more.
WALKS = ((3, 1), (7, 5), (11, 6), (13, 8), (17, 5), (23, 4), (1 << 30, 3))
#: Words of the items matched in one pass over the documents (about 60 bytes of index for each); larger benchmarks
#: take more passes.
ITEM_WORDS = 4_000_000


def allowed(n: int, share: float = EDITS) -> int:
    """Edits allowed for an item of n words."""
    return int(n * share)


def walks_for(n: int) -> int:
    return next(w for most, w in WALKS if n <= most)


def places_for(n: int, k: int) -> int:
    return 1 if k == 0 else 2 if n < 8 else 3


def walk_bits(words: np.ndarray, walk: int) -> np.ndarray:
    """Random functions of symbol and step of a walk: bit t of a symbol's number says whether step t moves on."""
    return mix64(words ^ _U((walk * 0x9E3779B97F4A7C15 + 0xC2B2AE3D27D4EB4F) & (2**64 - 1)))


def cgk(words: np.ndarray, walk: int, steps: int = STEPS) -> np.ndarray:
    """CGK walk of a sequence: the place of the symbol that each step copies, the length past its end."""
    bits, i = walk_bits(words, walk), 0
    out = np.full(steps, len(words), np.int64)
    for t in range(steps):
        if i == len(words):
            break
        out[t] = i
        i += int(bits[i] >> _U(t)) & 1
    return out


def _coefficients() -> np.ndarray:
    rng = np.random.default_rng(17)
    return rng.integers(0, 2**63, (8, STEPS // BLOCK, 4, 8, 4), dtype=_U) * _U(2) + _U(1)


_COEF = _coefficients()


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any stretch of the region, and where the first best stretch ends."""
    ramp = np.arange(len(region) + 1)
    prev = np.zeros(len(region) + 1, np.int64)
    for k, w in enumerate(item, 1):
        cur = np.empty_like(prev)
        cur[0] = k
        cur[1:] = np.minimum(prev[:-1] + (region != w), prev[1:] + 1)
        prev = np.minimum.accumulate(cur - ramp) + ramp
    end = int(prev.argmin())
    return int(prev[end]), end


@dataclass
class Index:
    """One block of items: their words end to end, and the band keys of their stretches, sorted."""

    ids: list
    words: list[np.ndarray]
    share: float = EDITS

    def __post_init__(self) -> None:
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.k = np.array([allowed(int(n), self.share) for n in self.n], np.int64)
        # stretches: of longer items one after the other, the last one up to the end
        item, start = [], []
        for i, n in enumerate(self.n.tolist()):
            at = [*range(0, n - STRETCH, STRETCH), n - STRETCH] if n > STRETCH else [0]
            item += [i] * len(at)
            start += at
        item, start = np.array(item, np.int64), np.array(start, np.int64)
        size = np.minimum(self.n[item], STRETCH) if len(item) else np.zeros(0, np.int64)
        flat = np.concatenate([*self.words, np.zeros(1, _U)])
        first = np.r_[0, np.cumsum(self.n)]
        places = np.array([places_for(int(n), int(k)) for n, k in zip(self.n, self.k, strict=True)], np.int64)
        walks = np.array([walks_for(int(n)) if k else 1 for n, k in zip(self.n, self.k, strict=True)], np.int64)
        self.kinds = sorted(set(places.tolist()))
        self.early = bool((self.n < LATE).any())
        self.walks = int(walks.max(initial=0))
        #: steps that each walk must take: those over the longest item that uses it
        self.steps = [int(min(STEPS, 2 * size[walks[item] > r].max(initial=0))) for r in range(self.walks)]
        keys, entry, place = [], [], []
        for r in range(self.walks):
            on = np.flatnonzero(walks[item] > r)
            base, length = first[item[on]] + start[on], size[on]
            i = np.zeros(len(on), np.int64)
            at = np.empty((STEPS, len(on)), np.int64)
            bits = walk_bits(flat, r)
            for t in range(self.steps[r]):
                at[t] = i
                i = i + ((bits[base + np.minimum(i, length - 1)] >> _U(t)) & _U(1)).astype(np.int64) * (i < length)
            for j, p, b, band in self.bands(r, early=True):
                # places that copy one word twice would tell less
                use = (places[item[on]] == p) & (at[band[-1]] < length) & (np.diff(at[list(band)], axis=0) > 0).all(0)
                if not j:
                    use &= self.n[item[on]] < LATE
                if use.any():
                    keys.append(self.key(r, j, p, b, [flat[base[use] + at[t, use]] for t in band]))
                    entry.append(item[on][use])
                    place.append(start[on][use] + at[band[0], use])
        keys = np.concatenate([np.zeros(0, _U), *keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.entry = np.concatenate([np.zeros(0, np.int64), *entry])[order].astype(np.int32)
        self.place = np.concatenate([np.zeros(0, np.int64), *place])[order].astype(np.int32)
        self.shift = _U(64 - min(26, max(16, (32 * len(keys)).bit_length())))
        self.maybe = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.maybe[self.keys >> self.shift] = True

    def bands(self, walk: int, early: bool) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
        """(block, places, band, steps sampled) of the bands of a walk; early: with those of the first block."""
        for j in range(0 if early else 1, -(-self.steps[walk] // BLOCK)):
            for p in self.kinds:
                if p > 1 or (walk == 0 and j == 0):
                    for b, band in enumerate(BANDS[p]):
                        steps = tuple(BLOCK * j + t for t in band)
                        if steps[-1] < self.steps[walk]:
                            yield j, p, b, steps

    @staticmethod
    def key(walk: int, j: int, p: int, b: int, symbols: list[np.ndarray]) -> np.ndarray:
        c = _COEF[walk, j, p, b]
        out = symbols[0] * c[0] + c[3]
        for s, m in zip(symbols[1:], c[1:], strict=False):
            out = out + s * m
        return out

    def candidates(self, words: np.ndarray, walks: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, place in the words) where a window agrees with an item in a whole band."""
        out = [np.zeros((0, 3), np.int64)]
        text = np.r_[words, _U(0)]
        for r in range(self.walks if walks is None else min(walks, self.walks)):
            # the eight bits of a block, a byte a word: eight times less to gather from
            bits = walk_bits(text, r).astype("<u8").view(np.uint8).reshape(-1, 8)
            q = np.arange(len(words))
            todo: dict[int, list] = {}
            for j, p, b, steps in self.bands(r, self.early):
                todo.setdefault(j, []).append((p, b, [t - BLOCK * j for t in steps]))
            for j in range(-(-self.steps[r] // BLOCK)):
                if j and len(q):
                    q = q[np.r_[True, q[1:] != q[:-1]]]  # walks keep their order: those that met lie side by side
                at = [q]
                move = np.ascontiguousarray(bits[:, j])
                for t in range(BLOCK):
                    g = np.take(move, q, mode="clip")
                    g >>= t
                    g &= 1
                    q = q + g  # past the end a walk reads the last symbol, whose place is none of a text
                    at.append(q)
                q = np.minimum(q, len(words))
                symbol: dict[int, np.ndarray] = {}
                for p, b, steps in todo.get(j, ()):
                    for t in steps:
                        if t not in symbol:
                            symbol[t] = np.take(text, at[t], mode="clip")
                    key = self.key(r, j, p, b, [symbol[t] for t in steps])
                    hit = np.flatnonzero(np.take(self.maybe, (key >> self.shift).view(np.int64), mode="clip"))
                    if not len(hit):
                        continue
                    lo = np.searchsorted(self.keys, key[hit])
                    some = self.keys[np.minimum(lo, len(self.keys) - 1)] == key[hit]
                    hit, lo = hit[some], lo[some]
                    count = np.searchsorted(self.keys, key[hit], "right") - lo
                    e = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                    out.append(np.stack([self.entry[e], self.place[e], np.repeat(at[steps[0]][hit], count)], 1))
        c = np.unique(np.concatenate(out), axis=0)
        return c[:, 0], c[:, 1], c[:, 2]

    def verify(self, words: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, end word) of the best stretch of each text for each item, where few enough edits do."""
        inside = pos < len(words)
        item, place, pos = item[inside], place[inside], pos[inside]
        doc = np.searchsorted(at, pos, "right") - 1
        k, n = self.k[item], self.n[item]
        # where the words at `place` and `pos` are one, the stretch lies in this region
        a = np.maximum(at[doc], pos - place - k)
        b = np.minimum(at[doc + 1], pos - place + n + k)
        order = np.lexsort((a, item, doc))
        doc, item, a, b = doc[order], item[order], a[order], b[order]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        s = 0
        while s < len(doc):
            d, i, lo, hi = doc[s], item[s], a[s], b[s]
            while (s := s + 1) < len(doc) and doc[s] == d and item[s] == i and a[s] <= hi:
                hi = max(hi, b[s])  # regions that overlap are one
            most = int(self.k[i])
            own, region = self.words[i], words[lo:hi]
            # every word that is not edited must be there
            if hi - lo < len(own) - most or np.isin(own, region).sum() < len(own) - most:
                continue
            edits, end = edit_distance(own, region)
            if edits <= most:
                key, found = (int(d), int(i)), (edits, int(lo + end - at[d]))
                best[key] = min(best.get(key, found), found)
        return [(d, i, *v) for (d, i), v in sorted(best.items())]

    def matches(self, col) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, end word) over an Arrow column of texts."""
        data, off = arrow_bytes(col)
        for first, _, words, at, _ in word_hashes(data, off, _SPLIT):
            found = self.candidates(words)
            if len(found[0]):
                for d, i, edits, end in self.verify(words, at, *found):
                    yield first + d, i, edits, end


def recall(n: int, walks: int | None = None, trials: int = 400, seed: int = 3, share: float = EDITS) -> float:
    """Share of items of n words that the bands find in a text that holds them with all allowed edits."""
    rng = np.random.default_rng([seed, n])
    draw = lambda size: rng.integers(1, 2**63, size, dtype=_U)
    items = [draw(n) for _ in range(trials)]
    index = Index(list(range(trials)), items, share)
    parts, at = [], [0]
    for w in items:
        w = list(w)
        for place in sorted(rng.choice(n, allowed(n, share), replace=False), reverse=True):
            gone, new = ((1, 1), (1, 0), (0, 1))[int(rng.integers(0, 3))]
            w[place : place + gone] = list(draw(new))
        parts.append(np.concatenate([draw(20), np.array(w, _U), draw(20)]))
        at.append(at[-1] + len(parts[-1]))
    item, _, pos = index.candidates(np.concatenate(parts), walks)
    return len(set(item[np.searchsorted(np.array(at), pos, "right") - 1 == item].tolist())) / trials


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, share: float = EDITS, size: int = ITEM_WORDS) -> Iterator[Index]:
    """The items in blocks of about `size` words; null, empty and wordless items are left out, equal texts kept."""
    import pyarrow as pa

    ids: list = []
    words: list[np.ndarray] = []
    held = 0
    rows: list = []

    def take() -> None:
        nonlocal held
        data, off = arrow_bytes(pa.array([r[1] for r in rows], pa.large_string()))
        for i, j, w, at, _ in word_hashes(data, off, _SPLIT):
            for k in range(i, j):
                own = w[at[k - i] : at[k - i + 1]]
                if len(own):
                    ids.append(rows[k][0])
                    words.append(own.copy())
                    held += len(own)
        rows.clear()

    for r in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == 1000:
            take()
            if held >= size:
                yield Index(ids, words, share)
                ids, words, held = [], [], 0
    take()
    if ids:
        yield Index(ids, words, share)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = EDITS) -> DataFrame:
    """(id, item, edits, item_words, end_word): one row for each document and item of which it holds a stretch within
    the allowed edits (words inserted, deleted or replaced; case of A-Z and ASCII punctuation do not count).

    Whole texts are read, once for each block of items. Null, empty and wordless texts match nothing; an empty
    benchmark or document table gives an empty result; repeated documents and items give repeated rows. end_word is
    the end of the first stretch of fewest edits. Only the named columns are read.
    """
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item {item_kind}, edits long, item_words long, end_word long"

    def scan(index: Index) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                hits = list(index.matches(batch.column(1)))
                if hits:
                    d, i, edits, end = zip(*hits, strict=True)
                    columns = [batch.column(0).take(pa.array(d)), pa.array([index.ids[k] for k in i]), pa.array(edits, pa.int64()), pa.array([int(index.n[k]) for k in i], pa.int64()), pa.array(end, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "edits", "item_words", "end_word"])

        return narrow.mapInArrow(run, schema)

    out = None
    for index in item_blocks(benchmark, item_col, item_text, share):
        hits = scan(index)
        out = hits if out is None else out.union(hits)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = EDITS) -> DataFrame:
    """docs without those that hold a benchmark item, columns unchanged; texts pass through one map for each block.

    Rows are judged one by one: null ids, repeated rows and other columns pass as they are; null, empty and wordless
    texts stay; an empty benchmark drops nothing, an empty table gives an empty one.
    """

    def keep(index: Index):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for d, *_ in index.matches(batch.column(batch.schema.get_field_index(text_col))):
                    ok[d] = False
                yield batch.filter(pa.array(ok))

        return run

    for index in item_blocks(benchmark, item_col, item_text, share):
        docs = docs.mapInArrow(keep(index), docs.schema)
    return docs
