"""Token counts of a unigram vocabulary by trie-shared dynamic programming.

Distinct pre-tokens form a trie. The forward score of a trie node (the best segmentation of its prefix) is computed
once, however many pre-tokens share it. Pre-tokens met together are sorted, so that the nodes of a depth lie in columns
and are scored at once (PieceTable); long ones pass one by one (TokenTrie).
"""

from __future__ import annotations

import math
import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Trie nodes a worker keeps between batches; a fuller trie is started anew.
MAX_NODES = 1_000_000
#: Characters of a pre-token that are shared through the trie; the scores of what follows are computed and not kept.
DEPTH = 64
#: Pre-tokens counted at once, and characters of distinct ones whose trie lies in memory at once.
PIECE, CELLS = 1_000_000, 1 << 20


def load_pieces(path: str = DEFAULT_MODEL) -> dict[str, float]:
    """Pieces of a public vocabulary file with unigram scores: the logarithm of a Zipf share by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [sp.id_to_piece(k) for k in range(sp.vocab_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(ranked))))
    return {p: -math.log(r + 2.7) - total for r, p in enumerate(ranked)}


class TokenTrie:
    """Forward scores and token counts of prefixes. A character that is no piece counts one token for each UTF-8 byte."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        #: every end of a piece: a suffix that isn't one can't grow into a piece
        self.tails = {p[k:] for p in pieces for k in range(len(p))}
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - 10.0
        self.root: dict = {}
        self.terminal: dict[str, int] = {}
        self.nodes = 0

    def _score(self, text: str, j: int, path) -> tuple[float, int]:
        """Best (score, tokens) of the first j characters; path holds those of shorter starts, the nearest last."""
        cost = len(text[j - 1].encode("utf-8", "surrogatepass"))
        score, n = path[-1]
        best = (score + self.byte * cost, -(n + cost))
        for back in range(1, min(len(path), self.longest) + 1):
            end = text[j - back : j]
            if end not in self.tails:
                break
            p = self.pieces.get(end)
            if p is not None:
                score, n = path[-back]
                best = max(best, (score + p, -(n + 1)))
        return best[0], -best[1]

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of the mark and the word (ties: fewest tokens).

        A step looks back over the longest piece only, so a word of any length takes bounded memory and linear time.
        """
        known = self.terminal.get(word)
        if known is not None:
            return known
        if self.nodes > MAX_NODES:
            self.root, self.terminal, self.nodes = {}, {}, 0
        text, node = MARK + word, self.root
        path: deque[tuple[float, int]] = deque([(0.0, 0)], self.longest)
        for j, c in enumerate(text[:DEPTH], 1):
            entry = node.get(c)
            if entry is None:
                entry = node[c] = (self._score(text, j, path), {})
                self.nodes += 1
            path.append(entry[0])
            node = entry[1]
        for j in range(DEPTH + 1, len(text) + 1):
            path.append(self._score(text, j, path))
        if len(text) <= DEPTH:
            self.terminal[word] = path[-1][1]
        return path[-1][1]


class PieceTable:
    """Token counts of many words at once, as TokenTrie gives them.

    The pieces, read backwards, are a trie of their own, whose edges (node, character) lie in an open hash table.
    """

    #: Odd multiplier of the hash, bits of a character, and what marks an empty place.
    STEP, CHAR, EMPTY = np.uint64(0x9E3779B97F4A7C15), np.uint64(21), np.uint64((1 << 64) - 1)

    def __init__(self, trie: TokenTrie) -> None:
        self.trie = trie
        edges: dict[tuple[int, str], int] = {}
        ends = {}
        for piece, score in trie.pieces.items():
            node = 0
            for c in reversed(piece):
                node = edges.setdefault((node, c), len(edges) + 1)
            ends[node] = score
        self.score = np.full(len(edges) + 1, np.nan)
        self.score[list(ends)] = list(ends.values())
        bits = max(8, (4 * len(edges)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.nodes = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, np.int32)
        key = np.array([node << 21 | ord(c) for node, c in edges], np.uint64)
        for k, at, node in zip(key, (key * self.STEP >> self.shift).tolist(), edges.values(), strict=True):
            while self.keys[at] != self.EMPTY:
                at = (at + 1) & int(self.last)
            self.keys[at], self.nodes[at] = k, node

    def _next(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Where the edges lead, 0 where there is none."""
        key = node.astype(np.uint64) << self.CHAR | char
        at = key * self.STEP >> self.shift
        found = self.keys[at]
        out = np.where(found == key, self.nodes[at], 0)
        more = np.flatnonzero((found != key) & (found != self.EMPTY))
        while len(more):
            at[more] = (at[more] + np.uint64(1)) & self.last
            found = self.keys[at[more]]
            out[more] = np.where(found == key[more], self.nodes[at[more]], 0)
            more = more[(found != key[more]) & (found != self.EMPTY)]
        return out

    def _columns(self, words: list[str], size: np.ndarray) -> np.ndarray:
        """Tokens of sorted distinct words of these sizes, the mark before each."""
        most, number = int(size.max()), len(words)
        chars = np.empty((number, most + 1), np.uint32)
        chars[:, 0] = ord(MARK)
        chars[:, 1:] = np.array(words, f"<U{most}").view(np.uint32).reshape(number, most)
        # the first place where a word leaves the one before it: from there on its nodes are new
        leaves = np.zeros(number, np.int64)
        leaves[1:] = np.minimum((chars[1:] != chars[:-1]).argmax(axis=1), size[:-1] + 1)
        best, least, out = [np.zeros(number)], [np.zeros(number, np.int64)], np.zeros(number, np.int64)
        for j in range(most + 1):
            row = np.flatnonzero((leaves <= j) & (j <= size))
            char = chars[row, j]
            cost = 1 + (char > 0x7F).astype(np.int64) + (char > 0x7FF) + (char > 0xFFFF)
            score, n = best[j][row] + self.trie.byte * cost, least[j][row] + cost
            here, node = np.arange(len(row)), np.zeros(len(row), np.int32)
            for start in range(j, -1, -1):
                node = self._next(node, chars[row[here], start])
                alive = node > 0
                here, node = here[alive], node[alive]
                if not len(here):
                    break
                whole = np.flatnonzero(~np.isnan(self.score[node]))
                at = here[whole]
                new, tokens = best[start][row[at]] + self.score[node[whole]], least[start][row[at]] + 1
                better = (new > score[at]) | (new == score[at]) & (tokens < n[at])
                score[at[better]], n[at[better]] = new[better], tokens[better]
            # words that share the node take it from the first of them
            shared = np.zeros(number, np.int64)
            shared[row] = np.arange(len(row))
            owner = np.zeros(number, np.int64)
            owner[row] = row
            owner = np.maximum.accumulate(owner)
            best.append(score[shared[owner]])
            least.append(n[shared[owner]])
            end = np.flatnonzero(size == j)
            out[end] = least[-1][end]
        return out

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = pa.array(words, pa.large_string()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.asarray(order).astype(np.int64)
        sorted_words = coded.dictionary.take(order)
        size = np.asarray(pc.utf8_length(sorted_words)).astype(np.int64)
        known = np.zeros(len(place), np.int64)
        long = np.flatnonzero(size >= DEPTH)
        known[place[long]] = [self.trie.count(w) for w in sorted_words.take(pa.array(long)).to_pylist()]
        short = np.flatnonzero(size < DEPTH)
        step = CELLS // DEPTH
        for at in range(0, len(short), step):
            some = short[at : at + step]
            known[place[some]] = self._columns(sorted_words.take(pa.array(some)).to_pylist(), size[some])
        return known[np.asarray(coded.indices)]


_tables: dict[str, PieceTable] = {}


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, n_words, n_tokens) of every document: pre-tokens are the NFKC text's runs between white space.

    A null or empty text has 0 of both. Each worker reads the vocabulary at `model` once and
    counts about PIECE pre-tokens, a text at least, at a time. Repeated rows give equal rows, an empty table an empty
    result; only the two named columns are read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = _tables.get(model)
        if table is None:
            table = _tables[model] = PieceTable(TokenTrie(load_pieces(model)))
        for batch in batches:
            words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            held, first = [], 0
            for k, t in enumerate(batch.column(1)):
                if t.is_valid:
                    t = t.as_py()
                    parts = (t if t.isascii() else unicodedata.normalize("NFKC", t)).split()
                    words[k] = len(parts)
                    held += parts
                if held and (len(held) >= PIECE or k == batch.num_rows - 1):
                    row = np.repeat(np.arange(first, k + 1), words[first : k + 1])
                    tokens[first : k + 1] = np.bincount(row - first, table.count(held), k + 1 - first)
                    held = []
                if not held:
                    first = k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], names=["id", "n_words", "n_tokens"])

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
