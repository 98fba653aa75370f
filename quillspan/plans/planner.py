"""From query trees to columns: one scan of the postings, one aggregation by document, one boolean expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import Child, Node, Query
from .schema import IndexSchema

DATE = ("y", "mo", "d", "h", "mi", "s")


def date_struct(parts) -> Column:
    """Six numbers, padded with zeros, as a struct that orders like the date."""
    six = (*parts, 0, 0, 0, 0, 0, 0)[:6]
    return F.struct(*[F.lit(int(v)).cast("int").alias(k) for k, v in zip(DATE, six, strict=True)])


def range_filter(q: Query, width: int) -> Column | None:
    """Rows inside a query's date and sort bounds, ends included; sort bounds are cut to the key's width and the upper
    one also takes in all keys that it begins."""
    out = None

    def also(c: Column) -> None:
        nonlocal out
        out = c if out is None else out & c

    if q.min_date is not None:
        also(F.col("dt") >= date_struct(q.min_date))
    if q.max_date is not None:
        also(F.col("dt") <= date_struct(q.max_date))
    if q.min_sortstring is not None:
        also(F.col("sortstring") >= q.min_sortstring[:width])
    if q.max_sortstring is not None:
        top = q.max_sortstring[:width]
        also((F.col("sortstring") <= top) | F.col("sortstring").startswith(top))
    return out


@dataclass
class Plan:
    """A search's tree, its distinct (query, term) slots and their statistics."""

    root: Node
    queries: list[Query]
    schema: IndexSchema
    num_docs: int
    doc_freq: dict[str, int]
    scoring: str = "idf"

    def __post_init__(self) -> None:
        self.slots: dict[tuple[int, str], int] = {}
        for t in self.root.terms():
            if t.text:
                self.slots.setdefault((t.query, t.text), len(self.slots))

    def _score(self, number: int, term: str) -> Column:
        """Score of one posting for one query: idf times the aggregate or the chosen fields' weighted scores."""
        import math

        q = self.queries[number]
        idf = math.log((self.num_docs + 1) / self.doc_freq[term])
        if q.fields is None:
            return F.col("agg") * (F.lit(idf) if self.scoring == "idf" else F.lit(1.0))
        names = sorted(q.fields)
        parts = [F.coalesce(F.col(f"fs_{f}"), F.lit(0.0)) * F.lit(float(q.fields[f])) * (F.lit(idf) if self.scoring == "idf" or k else F.lit(1.0)) for k, f in enumerate(names)]
        return sum(parts[1:], parts[0])

    def matched(self, postings: DataFrame, keep: list[str]) -> DataFrame:
        """(doc_num, keep..., s_i) of each document with a term of the search; s_i is null where slot i has no match.

        A document has one posting of a term, so a search of one term is a scan; only several terms meet by document.
        """
        terms = sorted({t for _, t in self.slots})
        rows = postings.where(F.col("term").isin(terms)) if terms else postings.where(F.lit(False))
        found = []
        for (number, term), i in self.slots.items():
            if term not in self.doc_freq:
                continue
            here = F.col("term") == term
            q = self.queries[number]
            limits = range_filter(q, self.schema.enable_sortstring or 1 << 30)
            if limits is not None:
                here = here & limits
            score = self._score(number, term)
            if q.fields is not None:
                here = here & (score != 0)
            found.append((f"s_{i}", F.when(here, score)))
        if len(terms) < 2:
            return rows.select("doc_num", *keep, *[c.alias(name) for name, c in found])
        aggs = [F.max(c).alias(name) for name, c in found] or [F.count(F.lit(1)).alias("n")]
        return rows.groupBy("doc_num", *keep).agg(*aggs)

    def present(self, t: Node) -> bool:
        return bool(t.text) and t.text in self.doc_freq

    def match(self, n: Node, skipped: frozenset[int] = frozenset()) -> Column:
        if n.kind == "term":
            return F.col(f"s_{self.slots[n.query, n.text]}").isNotNull() if self.present(n) else F.lit(False)
        need = [c for c in n.children if c.required and id(c) not in skipped]
        some = [c for c in n.children if not c.required and not c.negated]
        hits = need or some
        out = F.lit(bool(hits)) if need else F.lit(False)
        for c in hits:
            m = self.match(c.node, skipped)
            out = (out & m) if need else (out | m)
        for c in n.children:
            if c.negated:
                out = out & ~self.match(c.node, skipped)
        return out

    def score(self, n: Node, skipped: frozenset[int] = frozenset()) -> Column:
        """Sum over matching required and optional parts; 0 where the node doesn't match."""
        if n.kind == "term":
            return F.coalesce(F.col(f"s_{self.slots[n.query, n.text]}"), F.lit(0.0)) if self.present(n) else F.lit(0.0)
        parts = [self.score(c.node, skipped) for c in n.children if not c.negated]
        total = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
        return F.when(self.match(n, skipped), total).otherwise(F.lit(0.0))

    def bound(self, n: Node) -> bool:
        """Whether a node must match nothing because a term that it requires is absent."""
        if n.kind == "term":
            return not self.present(n)
        return any(c.required and self.bound(c.node) for c in n.children)

    def lenient(self) -> list[tuple[Node, list[Child]]]:
        """Nodes whose leading required compounds lose their force where they match no document (unless a negated
        part matches some): (node, its required compounds in order)."""
        out = []

        def walk(n: Node) -> None:
            for c in n.children:
                walk(c.node)
            compounds = [c for c in n.children if c.required and c.node.kind != "term"]
            if n.kind == "group" and compounds:
                out.append((n, compounds))

        walk(self.root)
        return out

    def settled(self) -> bool:
        """Whether no child can be skipped unless the whole search matches nothing: then a hit settles the rule."""
        return all(n is self.root for n, _ in self.lenient())

    def skips(self, rows: DataFrame) -> frozenset[int]:
        """Children to skip under the lenient rule. One aggregation gets the flags of all nodes; only where a node's
        skip changes what a node around it matches is the outer one asked again."""
        groups = [(n, compounds) for n, compounds in self.lenient() if any(not self.bound(c.node) for c in compounds)]
        skipped: frozenset[int] = frozenset()
        at = 0
        while at < len(groups):
            asked = groups[at:]
            flags, spans = [], []
            for n, compounds in asked:
                parts = [*compounds, *(c for c in n.children if c.negated)]
                spans.append((len(flags), len(compounds), len(parts)))
                flags += [F.coalesce(F.max(self.match(c.node, skipped)), F.lit(False)).alias(f"f{len(flags) + k}") for k, c in enumerate(parts)]
            got = rows.agg(*flags).first()
            before = skipped
            for (_, compounds), (first, size, every) in zip(asked, spans, strict=True):
                at += 1
                if not any(got[first + size : first + every]):
                    for c, hit in zip(compounds, got[first : first + size], strict=True):
                        if hit or self.bound(c.node):
                            break
                        skipped |= {id(c)}
                if skipped != before:
                    break
        return skipped
