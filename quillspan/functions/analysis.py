"""Text analysis: normal form, tokens, positions, stop words, stems and word pairs, as column expressions."""

from __future__ import annotations

import abc
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .porter2 import stem as porter2

#: English function words that a stemmed field leaves out of its single terms.
STOP_EN = frozenset(
    (
        "a i be he me we if of an in on do go no so to up or as is us at it by my "
        "had did and end the are off can who too two her for our was his get not but out you how may why any "
        "try some here were have each much such with back will them from than been then when even also into your this that what just "
        "must they only could would while there where these those being which still under other their might about should within because another without "
    ).split()
)


#: Bytes of word characters.
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")] = True


def normalize(c: Column) -> Column:
    """Null to empty, each run of ASCII white space to one space, none at the ends."""
    # a space by itself stays as it is, as to replace each takes long; so does an expression that begins with a choice
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\x0B\f\r](?:[ \t\n\x0B\f\r]+|(?<! ))", " "))


def split_words(texts: pa.Array, inner: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The runs of ASCII word characters of an array of strings, in order, and the row of each; inner: one apostrophe
    inside a word joins two runs. Equal to the token patterns of Plain and English, without a step for each token."""
    texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    word = _WORD[data]
    # a run begins where no word character precedes it in its row, and ends likewise
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    at = ends[:-1][ends[:-1] < len(data)]
    edge[at] = word[at]
    first = np.flatnonzero(edge)
    edge = word.copy()
    edge[:-1] &= ~word[1:]
    at = ends[1:][ends[1:] > 0] - 1
    edge[at] = word[at]
    last = np.flatnonzero(edge) + 1
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, ends)))
    if inner and len(first) > 1:
        link = (first[1:] - last[:-1] == 1) & (row[1:] == row[:-1])
        link[link] = data[last[:-1][link]] == ord("'")
        # of a chain of runs each second link joins
        place = np.arange(len(first))
        chain = np.maximum.accumulate(np.where(np.concatenate([[True], ~link]), place, 0))
        join = link & ((place - chain)[:-1] % 2 == 0)
        word[last[:-1][join]] = True
        first, row, last = first[np.concatenate([[True], ~join])], row[np.concatenate([[True], ~join])], last[np.concatenate([~join, [True]])]
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=offsets[1:])
    if offsets[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[word])), row
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[word])), row


class Language(abc.ABC):
    """Token pattern, stemmer and stop list of a language. Subclasses override; set_* replace single parts."""

    token_pattern = r"[A-Za-z0-9_]+"
    stoplist: frozenset[str] = frozenset()
    tokenizer: Callable[[Column], Column] | None = None
    stemmer: Callable[[str], str] | None = None

    @property
    @abc.abstractmethod
    def name(self) -> str: ...

    def set_tokenizer(self, tokenizer: Callable) -> Language:
        """Use a function from a text column to an array column of tokens."""
        if not callable(tokenizer):
            raise ValueError("the tokenizer must be callable")
        self.tokenizer = tokenizer
        return self

    def set_stemmer(self, stemmer: Callable[[str], str]) -> Language:
        """Use a function from a token to its stem."""
        if not callable(stemmer):
            raise ValueError("the stemmer must be callable")
        self.stemmer = stemmer
        return self

    def tokenize(self, c: Column) -> Column:
        """Tokens in order."""
        return self.tokenizer(c) if self.tokenizer else F.regexp_extract_all(c, F.lit(f"({self.token_pattern})"), F.lit(1))

    @property
    def words(self) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray]] | None:
        """Tokens of an Arrow array of texts and the row of each; None where the language has a way of its own."""
        own = self.tokenizer or type(self).tokenize is not Language.tokenize or type(self).stem_tokens is not Language.stem_tokens
        inner = {Plain.token_pattern: False, English.token_pattern: True}.get(self.token_pattern)
        return None if own or inner is None else lambda texts: split_words(texts, inner)

    def count_tokens(self, c: Column) -> Column:
        """The number of tokens."""
        words = self.words
        if words is None:
            return F.size(self.tokenize(c))

        @F.arrow_udf("int")
        def run(col: pa.Array) -> pa.Array:
            return pa.array(np.bincount(words(col)[1], minlength=len(col)).astype(np.int32), mask=np.asarray(pc.is_null(col)))

        return run(c)

    def positions(self, c: Column) -> Column:
        """Start offset, in characters, of each token of the pattern. One pass in Arrow batches: the built-in array
        functions could only sum the lengths before each token anew, which is quadratic in long texts."""
        pattern = re.compile(self.token_pattern)

        @F.arrow_udf("array<int>")
        def run(col: pa.Array) -> pa.Array:
            starts, ends = array("i"), [0]
            for text in col:
                starts.extend(m.start() for m in pattern.finditer(text.as_py() or ""))
                ends.append(len(starts))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.asarray(starts, np.int32)), mask=pc.is_null(col))

        return run(c)

    def stem_word(self, word: str) -> str:
        return self.stemmer(word) if self.stemmer else word

    @property
    def stems(self) -> bool:
        return self.stemmer is not None

    def stem_tokens(self, tokens: Column) -> Column:
        """Stem of each token; an empty stem stands for a dropped one."""
        if not self.stems:
            return tokens
        word = self.stem_word

        @F.arrow_udf("array<string>")
        def run(col: pa.Array) -> pa.Array:
            # each distinct token of a batch is stemmed once; lists stay in Arrow, a few bytes a token
            coded = col.flatten().dictionary_encode()
            stems = pa.array([None if w is None else word(w) for w in coded.dictionary.to_pylist()], pa.string())
            sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            return pa.ListArray.from_arrays(ends, stems.take(coded.indices), mask=pc.is_null(col))

        return run(tokens)


class Plain(Language):
    """No language: word characters, no stems, no stop words."""

    name = ""


class English(Language):
    """Keeps an inner apostrophe, strips a final 's before stemming, Porter2 stems, English stop words."""

    name = "En"
    token_pattern = r"[A-Za-z0-9_]+(?:'[A-Za-z0-9_]+)?"
    stoplist = STOP_EN

    def stem_word(self, word: str) -> str:
        word = word.removesuffix("'s")
        return self.stemmer(word) if self.stemmer else porter2(word)

    @property
    def stems(self) -> bool:
        return True


class Croatian(Language):
    """Word characters; stems only through set_stemmer, as no affix file is public with the reference."""

    name = "Hr"


LANGUAGES: dict[str, type[Language]] = {"": Plain, "En": English, "Hr": Croatian}


def language(name: str = "") -> Language:
    """A new language object by its name."""
    if name not in LANGUAGES:
        raise ValueError(f"no language {name!r}; known are {sorted(LANGUAGES)}")
    return LANGUAGES[name]()


def bare(token: Column) -> Column:
    """A token without its final 's, as the stop list sees it."""
    return F.regexp_replace(token, "'s$", "")


def word_pairs(tokens: Column) -> Column:
    """Each two neighbouring tokens, joined by a space."""
    n = F.size(tokens)
    follow = F.when(n > 1, F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    head = F.when(n > 1, F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.zip_with(head, follow, lambda a, b: F.concat_ws(" ", a, b))


def drop_stopwords(stems: Column, tokens: Column, stoplist: Iterable[str]) -> Column:
    """stems without those whose unstemmed token is a stop word, and without empty ones."""
    stop = sorted(stoplist)
    kept = F.filter(F.arrays_zip(stems.alias("s"), tokens.alias("t")), lambda p: (p["s"] != "") & (~bare(p["t"]).isin(stop) if stop else F.lit(True)))
    return F.transform(kept, lambda p: p["s"])
