"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the terms present in a text. The pairwise part
learns combinations (an insult together with a group mention) that additive weights miss; it costs no more than the
linear part since sum_{i<j} <v_i, v_j> = ((sum v_i)^2 - sum v_i^2) / 2.

Terms enter the model by what they say alone or by what two of them say together beyond the sum of both, so words that
mean nothing without each other are learned too. Settings are compared on a fold inside the training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, word_hashes

#: Hash space of terms, in bits.
BITS = 32
_FRONT = np.int64(BITS - 20)
#: Labelled rows that the fit may gather on the driver: the rows with the least id hash, at most so many; and the
#: terms of these rows (4 bytes each), after which no further row is gathered.
MAX_ROWS = 20_000
MAX_TERMS = 30_000_000
#: Rows that must hold a term, or two terms together, for their association with the label to count.
MIN_ROWS = 3
#: The most frequent terms, so many, are tested in pairs; and the association (chi-square) from which a pair enters.
PAIR_TERMS = 3000
PAIR_CHI2 = 40.0
RANK = 4
#: Settings compared on the inner fold: association of a term with the label (chi-square) from which it enters alone,
#: and decay of the parameters.
SETTINGS = ((20.0, 0.001), (20.0, 0.004), (40.0, 0.004))

_SPLIT = np.zeros(256, bool)
_SPLIT[:128] = [not chr(c).isalnum() for c in range(128)]


def text_terms(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, text number, term) of each distinct term of each text: words and their first 4 bytes."""
    data, off = arrow_bytes(col)
    for i, j, words, at, start in word_hashes(data, off, _SPLIT, prefix=4):
        own = np.repeat(np.arange(i, j), np.diff(at))
        shift = np.uint64(64 - BITS)
        doc, term = np.concatenate([own, own[start > 0]]), np.concatenate([words >> shift, start[start > 0] >> shift])
        yield i, j, doc, term.astype(np.int64)


@dataclass(frozen=True)
class FactorizationMachine:
    """w0, and for the chosen terms (sorted) their weights w and factors v."""

    w0: float
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def finder(self) -> Callable[[np.ndarray], np.ndarray]:
        """Function from terms to their numbers in the model (-1: not chosen)."""
        front = np.zeros(1 << 20, bool)
        front[self.terms >> _FRONT] = True

        def find(term: np.ndarray) -> np.ndarray:
            out = np.full(len(term), -1, np.int64)
            maybe = np.flatnonzero(front[term >> _FRONT])
            at = np.searchsorted(self.terms, term[maybe])
            at[at == len(self.terms)] = 0
            hit = self.terms[at] == term[maybe] if len(self.terms) else np.zeros(0, bool)
            out[maybe[hit]] = at[hit]
            return out

        return find

    def scores(self, n: int, doc: np.ndarray, idx: np.ndarray) -> np.ndarray:
        """Scores of n texts from the (text, chosen term) pairs present."""
        z = self.w0 + np.bincount(doc, self.w[idx], n)
        for f in range(self.v.shape[1]):
            x = self.v[idx, f]
            z += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Sample:
    """Terms of labelled rows: `flat` holds them row after row, `own` the row of each."""

    flat: np.ndarray
    own: np.ndarray
    labels: np.ndarray

    @staticmethod
    def of(ids: list[np.ndarray], labels: np.ndarray) -> Sample:
        # 32-bit numbers keep the driver's memory at a few bytes for each term of the sample
        flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.uint32)
        return Sample(flat, np.repeat(np.arange(len(labels), dtype=np.int32), [len(x) for x in ids]), labels)

    def rows(self, keep: np.ndarray) -> Sample:
        on = keep[self.own]
        return Sample(self.flat[on], (np.cumsum(keep) - 1)[self.own[on]].astype(np.int32), self.labels[keep])

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sorted terms of those that rows hold, and the rows, in bounded pieces."""
        at, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for k in range(0, len(self.flat) if len(terms) else 0, 1 << 20):
            piece = self.flat[k : k + (1 << 20)]
            place = np.searchsorted(terms, piece)
            place[place == len(terms)] = 0
            hit = terms[place] == piece
            at.append(place[hit].astype(np.int32))
            rows.append(self.own[k : k + (1 << 20)][hit])
        return np.concatenate(at), np.concatenate(rows)


def single_terms(s: Sample) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in at least MIN_ROWS rows (and not in all), their rows, rows labelled 1, and chi-square with the label."""
    n, pos = len(s.labels), s.labels.sum()
    vocab, df = np.unique(s.flat, return_counts=True)
    keep = (df >= MIN_ROWS) & (df < n)
    vocab, df = vocab[keep], df[keep].astype(float)
    idx, rows = s.places(vocab)
    hit = np.bincount(idx[(s.labels > 0)[rows]], minlength=len(vocab)).astype(float)
    return vocab, df, hit, (hit - df * pos / n) ** 2 / (df * (pos / n) * (1 - pos / n) * (1 - df / n))


def pair_terms(s: Sample, vocab: np.ndarray, df: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Terms that say something together with another one, beyond the sum of what both say alone.

    Rows that hold both are counted for all pairs of the PAIR_TERMS most frequent terms (of those in at most half the
    rows), by products of row blocks. Where two terms add up, the share of label 1 is that of the first plus that of
    the second less the overall one.
    """
    n, base = len(s.labels), s.labels.mean()
    able = np.flatnonzero(df <= n / 2)
    top = np.sort(able[np.lexsort((vocab[able], -df[able]))[:PAIR_TERMS]])
    m = len(top)
    if m < 2:
        return np.zeros(0, np.uint32)
    idx, rows = s.places(vocab[top])
    bounds = np.searchsorted(rows, np.arange(0, n + 1024, 1024))
    share = (hit[top] / df[top]).astype(np.float32)
    out = np.zeros(m, bool)
    for i in range(0, m, 512):  # a stripe of the table of pairs at a time
        both, ones = np.zeros((len(top[i : i + 512]), m), np.float32), np.zeros((len(top[i : i + 512]), m), np.float32)
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            block = np.zeros((min(1024, n - 1024 * k), m), np.float32)
            block[rows[a:b] - 1024 * k, idx[a:b]] = 1
            both += block[:, i : i + 512].T @ block
            block = block[s.labels[1024 * k : 1024 * (k + 1)] > 0]
            ones += block[:, i : i + 512].T @ block
        x, z = np.broadcast_arrays(share[i : i + 512, None], share[None, :])
        both_add = x + z - base
        # terms that go together anyway are no pair: a share anywhere between one term's own and the sum is expected
        e = np.clip(ones / np.maximum(both, 1), np.minimum(np.minimum(x, z), both_add), np.maximum(np.maximum(x, z), both_add))
        e = np.clip(e, base / 10, 1 - (1 - base) / 10)
        var = both * e * (1 - e)
        odd = (both >= MIN_ROWS) & (var >= 2) & ((ones - both * e) ** 2 >= PAIR_CHI2 * var)
        odd[np.arange(len(odd)), np.arange(i, i + len(odd))] = False
        out[i : i + 512] |= odd.any(1)
        out |= odd.any(0)
    return vocab[top[out]]


def fit(s: Sample, terms: np.ndarray, decay: float, rank: int = RANK, epochs: int = 30, least_steps: int = 1500, rate: float = 0.05, seed: int = 7) -> FactorizationMachine:
    """Fit the parameters of the chosen terms by mini-batch Adam with decoupled decay and a falling rate, for so many
    epochs and steps at least. Without both labels the model is a constant."""
    n, pos = len(s.labels), int(s.labels.sum())
    w0 = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    if not pos or pos == n:
        return FactorizationMachine(w0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)))
    labels = s.labels
    idx, own = s.places(terms)
    rng = np.random.default_rng(seed)
    m = len(terms)
    p = np.concatenate([[w0], np.zeros(m), rng.normal(0, 0.1, m * rank)])
    g1, g2 = np.zeros_like(p), np.zeros_like(p)
    bounds = np.searchsorted(own, np.arange(n + 1))
    batches = max(1, n // 256)
    rounds = max(epochs, -(-least_steps // batches))
    step = 0
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(n), batches):
            k = bounds[rows + 1] - bounds[rows]
            at = np.repeat(bounds[rows] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
            d, j = np.repeat(np.arange(len(rows)), k), idx[at]
            w, v = p[1 : m + 1], p[m + 1 :].reshape(m, rank)
            z = p[0] + np.bincount(d, w[j], len(rows))
            vj = v[j]
            sums = np.stack([np.bincount(d, vj[:, f], len(rows)) for f in range(rank)], 1)
            q = np.bincount(d, (vj * vj).sum(1), len(rows))
            z += 0.5 * ((sums * sums).sum(1) - q)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            gv = e[d][:, None] * (sums[d] - vj)
            grad = np.concatenate([[e.sum()], np.bincount(j, e[d], m), np.stack([np.bincount(j, gv[:, f], m) for f in range(rank)], 1).ravel()])
            step += 1
            g1 = 0.9 * g1 + 0.1 * grad
            g2 = 0.999 * g2 + 0.001 * grad * grad
            now = rate * (1 - (step - 1) / (rounds * batches))
            p[1:] -= now * decay * p[1:]
            p -= now * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(float(p[0]), terms.astype(np.int64), p[1 : m + 1].copy(), p[m + 1 :].reshape(m, rank).copy())


def fit_sample(s: Sample, inner: np.ndarray, settings=SETTINGS) -> FactorizationMachine:
    """The model of all rows under the settings that lose least on the inner fold, having been fitted on the others."""
    best = settings[0]

    def chosen(part: Sample, bounds: set[float]) -> dict[float, np.ndarray]:
        if not 0 < part.labels.sum() < len(part.labels):
            return dict.fromkeys(bounds, np.zeros(0, np.uint32))
        vocab, df, hit, chi2 = single_terms(part)
        pairs = pair_terms(part, vocab, df, hit)
        return {c: np.union1d(vocab[chi2 >= c], pairs) for c in bounds}

    fold = s.rows(inner)
    if len(settings) > 1 and 0 < fold.labels.sum() < len(fold.labels):
        rest = s.rows(~inner)
        terms = chosen(rest, {c for c, _ in settings})

        def loss(model: FactorizationMachine) -> float:
            idx, own = fold.places(model.terms.astype(np.uint32))
            p = np.clip(model.scores(len(fold.labels), own, idx), 1e-6, 1 - 1e-6)
            return float(-np.mean(fold.labels * np.log(p) + (1 - fold.labels) * np.log(1 - p)))

        best = min(settings, key=lambda c: loss(fit(rest, terms[c[0]], c[1])))
    return fit(s, chosen(s, {best[0]})[best[0]], best[1])


def checksum(id_col: str) -> Column:
    """crc32 of the id as text (a null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def held_out(id_col: str) -> Column:
    """True for the fold that the fit never sees."""
    return checksum(id_col) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """Fit on labelled rows outside the held-out fold, at most max_rows of them (and MAX_TERMS terms) by least id hash:
    the driver's bound. The fold by which settings are chosen is remainder 1 of the same checksum, a part of the
    training rows. A label other than 0 and 1 and a null id teach nothing; of two labels of an id 1 counts; an id
    that many rows repeat teaches by the least of their term lists.
    """
    lab = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    lab = lab.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    lab = lab.orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def terms(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [np.zeros(0, np.int64)] * batch.num_rows
            for i, j, doc, term in text_terms(batch.column(1)):
                both = np.unique((doc.astype(np.int64) << BITS) | term)
                cut = np.searchsorted(both >> BITS, np.arange(i, j + 1))
                for k in range(i, j):
                    out[k] = both[cut[k - i] : cut[k - i + 1]] & ((1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.astype(np.uint32).tobytes() for x in out], pa.binary())], names=["id", "label", "terms"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), "id")
    kind = dict(docs.dtypes)[id_col]
    lists = rows.select("id", "text", "label").mapInArrow(terms, f"id {kind}, label int, terms binary")
    # an id that many rows repeat gives one list
    per = lists.groupBy("id").agg(F.max("label").alias("label"), F.min("terms").alias("terms")).withColumn("inner", checksum("id") % 5 == 1)
    ids, got, fold, held = [], [], [], 0
    for r in per.orderBy(F.xxhash64("id"), "id").toLocalIterator():
        held += len(r.terms) // 4
        if held > MAX_TERMS and ids:
            break
        ids.append(np.frombuffer(bytes(r.terms), np.uint32))
        got.append(r.label)
        fold.append(r.inner)
    return fit_sample(Sample.of(ids, np.array(got, float)), np.array(fold, bool))


def score_texts(df: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row; whole texts are read, a null or empty text scores the constant."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        find = model.finder()
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, j, doc, term in text_terms(batch.column(1)):
                idx = find(term)
                keep = idx >= 0
                both = np.unique((doc[keep].astype(np.int64) << 32) | idx[keep])
                score[i:j] = model.scores(j - i, (both >> 32) - i, both & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labels, then score every document. Repeated rows score alike; no rows give no rows; without usable
    labels every score is one constant under 0.5 or over it as the labels are."""
    return score_texts(docs, train(docs, labels, id_col, text_col), id_col, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows predicted toxic, columns unchanged; texts pass through one map, nothing is shuffled.

    Rows are judged one by one: null ids, repeated rows and other columns pass as they are; null and empty texts score
    the constant; an empty table gives an empty one.
    """
    model = train(docs, labels, id_col, text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        find = model.finder()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, j, doc, term in text_terms(batch.column(batch.schema.get_field_index(text_col))):
                idx = find(term)
                sel = idx >= 0
                both = np.unique((doc[sel].astype(np.int64) << 32) | idx[sel])
                keep[i:j] = model.scores(j - i, (both >> 32) - i, both & 0xFFFFFFFF) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
