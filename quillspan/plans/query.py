"""Query strings: phrases, groups, signs and AND / OR / AND NOT, parsed on the driver to a small tree.

Precedence: quotes, then + and -, then parentheses, then the words AND, OR, AND NOT. A word between two items groups
its neighbours, from left to right, without precedence among the three.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.analysis import Language

_PHRASE = re.compile(r'"([^"]*[^"\s][^"]*)("|\Z)')
_OPERATOR = re.compile(r"(AND NOT|AND|OR)(?!\w)", re.A)
_WORD_CHAR = re.compile(r"\w", re.A)


@dataclass(frozen=True)
class Query:
    """One query of a search.

    fields maps field names to weights; date bounds are lists of up to six numbers, padded with zeros; the sort bounds
    are strings. required and negated say how this query combines with others of the same search.
    """

    string: str
    any_or_all: str = "any"
    lowercase: bool = False
    tokenize: bool = False
    stem: bool = False
    required: bool = False
    negated: bool = False
    fields: dict[str, float] | None = None
    allow_boolean: bool = True
    allow_phrases: bool = True
    min_sortstring: str | None = None
    max_sortstring: str | None = None
    min_date: tuple[int, ...] | None = None
    max_date: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        if self.any_or_all not in ("any", "all"):
            raise ValueError(f"any_or_all is {self.any_or_all!r}")


@dataclass(frozen=True)
class Node:
    """Part of a query: kind is term, phrase (all its pairs needed) or group. A term without text matches nothing."""

    kind: str
    text: str = ""
    children: tuple[Child, ...] = ()
    query: int = 0

    def terms(self) -> list[Node]:
        return [self] if self.kind == "term" else [t for c in self.children for t in c.node.terms()]


@dataclass(frozen=True)
class Term(Node):
    kind: str = "term"


@dataclass(frozen=True)
class Phrase(Node):
    kind: str = "phrase"


@dataclass(frozen=True)
class BoolGroup(Node):
    kind: str = "group"


@dataclass(frozen=True)
class Child:
    node: Node
    required: bool = False
    negated: bool = False


@dataclass
class _Item:
    node: Node | None = None
    sign: str = ""
    operator: str = ""


@dataclass
class Parser:
    """Parses one query; stopwords gathers the query words on the stop list."""

    query: Query
    language: Language
    stoplist: frozenset[str]
    number: int = 0
    tokens_of: Callable[[str], list[str]] | None = None
    stopwords: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.token = re.compile(self.language.token_pattern)
        if self.tokens_of is None:
            self.tokens_of = self.token.findall

    def parse(self) -> Node:
        q = self.query
        if not q.tokenize:
            text = q.string.lower() if q.lowercase else q.string
            return self._term(text)
        items, _ = self._items(q.string, 0, False)
        if len([i for i in items if i.node]) == 1:
            for i in items:  # the sign of an only item has no effect
                i.sign = ""
        return self._group(items)

    def _term(self, text: str) -> Node:
        return Term(text=text, query=self.number)

    def _word(self, token: str) -> Node:
        q = self.query
        text = token.lower() if q.lowercase else token
        if text.removesuffix("'s") in self.stoplist:
            self.stopwords.append(text)
        if q.stem:
            text = self.language.stem_word(text) or text
        return self._term(text)

    def _phrase(self, text: str) -> Node:
        q = self.query
        tokens = self.tokens_of(text.lower() if q.lowercase else text)
        self.stopwords += [t for t in tokens if t.removesuffix("'s") in self.stoplist]
        if len(tokens) < 2:
            if not tokens or tokens[0] in self.stoplist:
                return self._term("")
            return self._term((self.language.stem_word(tokens[0]) or tokens[0]) if q.stem else tokens[0])
        stems = [self.language.stem_word(t) if q.stem else t for t in tokens]
        return Phrase(children=tuple(Child(self._term(f"{a} {b}"), required=True) for a, b in zip(stems, stems[1:], strict=False)), query=self.number)

    def _items(self, s: str, at: int, inside: bool) -> tuple[list[_Item], int]:
        """Items from a place to the end, or inside a group to its closing parenthesis."""
        q, out, sign, begin = self.query, [], "", True
        while at < len(s):
            c = s[at]
            m = _PHRASE.match(s, at) if c == '"' and q.allow_phrases else None
            if m:
                at = m.end()
                glued = self.token.match(s, at)
                if glued:
                    at = glued.end()
                out.append(_Item(self._term("") if glued else self._phrase(m[1]), sign))
                sign, begin = "", False
                continue
            if q.allow_boolean and c == "(":
                items, at = self._items(s, at + 1, True)
                if items:
                    out.append(_Item(self._group(items), sign))
                sign, begin = "", False
                continue
            if q.allow_boolean and c == ")" and inside:
                return out, at + 1
            if c in "+-" and q.allow_boolean and begin and self._starts(s, at + 1):
                sign, begin, at = c, False, at + 1
                continue
            word = _OPERATOR.match(s, at)
            if word and not (at and _WORD_CHAR.match(s[at - 1])):
                at = word.end()
                if q.allow_boolean:
                    out.append(_Item(operator=word[1]))
                sign, begin = "", False
                continue
            m = self.token.match(s, at)
            if m:
                at = m.end()
                glued = _PHRASE.match(s, at) if q.allow_phrases else None
                if glued:
                    at = glued.end()
                    node = self._term("")
                else:
                    parts = self.tokens_of(m[0])
                    words = [self._word(t) for t in parts]
                    every = q.any_or_all == "all"
                    node = words[0] if len(words) == 1 else BoolGroup(children=tuple(Child(w, required=every) for w in words), query=self.number)
                out.append(_Item(node, sign))
                sign, begin = "", False
                continue
            sign, begin = "", c.isspace()
            at += 1
        return out, at

    def _starts(self, s: str, at: int) -> bool:
        """Whether an item starts here: a word, or a phrase or group where those are read."""
        if at >= len(s):
            return False
        return bool(_WORD_CHAR.match(s[at]) or s[at] == "(" or (self.query.allow_phrases and _PHRASE.match(s, at)))

    def _child(self, item: _Item, required: bool, negated: bool = False) -> Child:
        if item.sign:
            required, negated = item.sign == "+", item.sign == "-"
        return Child(item.node, required and not negated, negated)

    def _group(self, items: list[_Item]) -> Node:
        out: list[_Item] = []
        operator = ""
        for item in items:
            if item.operator:
                operator = operator or item.operator
                continue
            if operator and out:
                left = out.pop()
                children = {
                    "AND": (self._child(left, True), self._child(item, True)),
                    "OR": (self._child(left, False), self._child(item, False)),
                    "AND NOT": (self._child(left, True), self._child(item, False, True)),
                }[operator]
                item = _Item(BoolGroup(children=children, query=self.number))
            operator = ""
            out.append(item)
        every = self.query.any_or_all == "all"
        children = tuple(self._child(i, every) for i in out)
        if len(children) == 1 and not children[0].negated:
            return children[0].node
        return BoolGroup(children=children, query=self.number)
