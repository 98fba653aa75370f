"""URL filters: host and path rules plus pattern rules, found through their rarest literal token.

Every rule is compiled to regular expressions over host and path and filed under the literal token of its text that
the fewest rules contain. A URL's tokens fetch candidate rules, and only those run their expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class UrlRule:
    """A rule for a host, its subdomains and a path start; longest name wins."""

    action: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def patterns(self) -> tuple[str, str]:
        return rf"(?:.*\.)?{re.escape(self.host)}", rf"{re.escape(self.path)}.*"

    @property
    def literal(self) -> str:
        # a path may go on after the rule's end, so its last token may be part of a longer one: not a sure literal
        return self.host + " " + re.sub(r"[A-Za-z0-9]+\Z", "", self.path)


@dataclass(frozen=True)
class PatternRule:
    """Regular expressions that the whole host and the whole path match; literal names tokens that every match contains whole."""

    action: str
    host: str = ".*"
    path: str = ".*"
    literal: str = ""

    @property
    def patterns(self) -> tuple[str, str]:
        return self.host, self.path


#: The fixed rules of the query.
RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)
#: The method's own rules: where no fixed rule fits, the first that fits decides, and none means allow.
PATTERNS = (
    PatternRule("block", r"(?:.*[.-])?casino[.-].*", literal="casino"),
    PatternRule("block", r"(?:.*[.-])?adult[.-].*", literal="adult"),
    PatternRule("block", r"(?:.*[.-])?(?:spam-farm)\..*", literal="spam farm"),
    PatternRule("block", path=r"(?:.*/)?(?:wp-login|xmlrpc)\.php", literal="php"),
    # an address has no literal word: the one rule that every URL without a fixed rule runs
    PatternRule("block", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?"),
)


class RuleIndex:
    """Rules by rarest literal token; rules without one are always candidates."""

    def __init__(self, rules) -> None:
        tokens = [sorted(set(_TOKEN.findall(r.literal.translate(_LOWER)))) for r in rules]
        often = Counter(t for ts in tokens for t in ts)
        self.by_token: dict[str, list[int]] = {}
        self.rules = [(r, *(re.compile(p, re.S) for p in r.patterns)) for r in rules]
        for k, ts in enumerate(tokens):
            self.by_token.setdefault(min(ts, key=lambda t: (often[t], t)) if ts else "", []).append(k)

    def matches(self, host: str, path: str, tokens: set[str]) -> list[int]:
        """Numbers of the rules that fit, in rule order."""
        found = [k for t in (*tokens, "") for k in self.by_token.get(t, ())]
        return sorted(k for k in found if self.rules[k][1].fullmatch(host) and self.rules[k][2].fullmatch(path))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge(url: str | None, fixed: RuleIndex, own: RuleIndex) -> tuple[str, str, str | None, str]:
    host, path = split_url(url)
    if not host and not path:
        return host, path, None, "allow"
    tokens = {*_TOKEN.findall(host), *_TOKEN.findall(path.translate(_LOWER))}
    hits = fixed.matches(host, path, tokens)
    if hits:
        rule = max((fixed.rules[k][0] for k in hits), key=lambda r: (len(r.name), r.name))
        return host, path, rule.name, rule.action
    hits = own.matches(host, path, tokens)
    return host, path, None, own.rules[hits[0]][0].action if hits else "allow"


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, patterns=PATTERNS) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    The rule lists go to the workers inside the task, so they must fit in memory (10,000 rules take about 10 MB).
    A null URL or one without `://` has empty host and path, no rule and the verdict allow. Rows are judged one by
    one: repeats give equal rows, an empty table an empty result; only the two named columns are read.
    """
    rules, patterns = tuple(rules), tuple(patterns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fixed, own = RuleIndex(rules), RuleIndex(patterns)
        for batch in batches:
            columns = zip(*[judge(u, fixed, own) for u in batch.column(1).to_pylist()], strict=True) if batch.num_rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["id", "host", "path", "rule", "verdict"])

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def oracle_sql() -> str:
    """DuckDB SQL of judge_urls over `pages` with the default rules."""
    return r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '(?s)^[^?#]*') ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)/.*') AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|[.-])casino[.-]') OR regexp_matches(host, '(^|[.-])adult[.-]') OR regexp_matches(host, '(^|[.-])spam-farm\.')
    OR regexp_matches(path, '(^|/)(wp-login|xmlrpc)\.php$') OR regexp_matches(host, '^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r"""
