"""License scans by canonical digest lookup.

A text is brought to a canonical form (case, punctuation, copyright notices, line wraps, equivalent spellings) and its
digest is hash-joined with the digests of known license texts. The same form of each line finds one-line notices.
The known full texts lie beside this module, as their publishers distribute them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Spellings that count as equal, applied in this order to the words between single spaces.
SPELLINGS = (
    ("https ", "http "), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("licence", "license"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("per cent", "percent"), ("merchantibility", "merchantability"),
)
#: Marks outside ASCII that count as punctuation.
MARKS = "®™“”‘’–—…«»•· ﻿"
#: What may begin or end a line besides its text: white space and the marks of comments.
EDGE = " \t\r\v\f*#/;%|-"
#: A copyright notice runs to a license's opening, "all rights reserved" or its paragraph's end, over at most so many
#: characters; a longer one is text. Where lines break has no say in it.
NOTICE_CHARS = 300
_OPENINGS = "permission is hereby granted|permission to use|redistribution and use|licensed under|released under|this program is free|this library is free|everyone is permitted|this software is provided"
_BEGIN = r"(?:\bcopyright:? ?(?:\(c\)|[0-9]{4}|by |\[yyyy\]|\[year\]|<year>|\{yyyy\})|\(c\) ?(?:copyright|[0-9]{4}))"
NOTICE = rf"{_BEGIN}[^\x01]{{0,{NOTICE_CHARS}}}?(?:all rights reserved|({_OPENINGS})|(\x01)|$)"
_NOTICE = re.compile(NOTICE)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MARKS = re.compile(f"[{MARKS}]")
#: Words of which every known text holds one, in any spelling: other lines need no digest.
_CUES = ("licen", "permission", "redistribution")

#: One-line notices by name.
NOTICES = (
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
)


@lru_cache(maxsize=1)
def known_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of the one-line notices and of every full text: as published, without its title and without the
    instructions after its terms; the MIT text also under its other title."""
    out = list(NOTICES)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        out.append((name, text))
        if name in ("MIT", "0BSD", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
            bare = text.split("\n", 1)[1]
            out.append((name, bare))
            if name == "MIT":
                out.append((name, "The MIT License (MIT)\n" + bare))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(name, terms), (name, terms + end)]
    return tuple(out)


def canonical(text: str | None) -> str:
    """Canonical form of a text; texts that differ in case, punctuation, copyright notices, comment marks, line wraps
    or the listed spellings share it."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    s = raw.decode("utf-8", "surrogatepass")
    if not s.isascii():
        s = _MARKS.sub(" ", s.replace("©", "(c)"))
    if "copyright" in s or "(c)" in s:
        lines = [line.strip(EDGE) for line in s.split("\n")]
        s = " ".join(line or "\x01" for line in lines)
        s = re.sub(r"[ \t\r\v\f]+", " ", s)
        s = _NOTICE.sub(r" \1\2", s)
    s = s.replace("&", " and ")
    words = s.encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    s = b" ".join(words).decode("utf-8", "surrogatepass")
    for a, b in SPELLINGS:
        if a in s:
            s = s.replace(a, b)
    return s


def _hex(form: str) -> str:
    return hashlib.md5(form.encode("utf-8", "surrogatepass")).hexdigest()


def digest(text: str | None) -> str:
    return _hex(canonical(text))


def known_digests(texts: Iterable[tuple[str, str]] | None = None) -> dict[str, str]:
    """Digest to name of the known texts; a text without words is left out."""
    texts = known_texts() if texts is None else texts
    return {_hex(form): name for name, t in texts if (form := canonical(t))}


def _scan(cues: tuple[str, ...]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            whole, lines = [], []
            for t in batch.column(1).to_pylist():
                whole.append(digest(t))
                low = (t or "").lower()
                some = t and (not cues or any(c in low for c in cues))
                lines.append([_hex(form) for line in t.split("\n") if (not cues or any(c in line.lower() for c in cues)) and (form := canonical(line))] if some else [])
            columns = [batch.column(0), batch.column(2), pa.array(whole, pa.string()), pa.array(lines, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "digest", "lines"])

    return run


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """(id, digest, license, n_notices, notices) of every document.

    license names the known license whose entire canonical text equals the document's (else null). notices lists the
    licenses of lines that equal a known text, by name, each once; n_notices counts the lines. Both come from a join
    of digests, broadcast only where the planner finds the known table small. A null text, an empty one and one of
    copyright notices only share the digest of the empty string. Rows are told apart inside, so repeated rows and ids
    give a row each; an empty table gives an empty result; only the two named columns are read. texts replaces the
    known (name, text) pairs.
    """
    known = known_digests(texts)
    every = known_texts() if texts is None else tuple(texts)
    cues = _CUES if all(any(c in t.lower() for c in _CUES) for _, t in every) else ()
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    scanned = materialize(rows.mapInArrow(_scan(cues), f"id {kind}, row long, digest string, lines array<string>"), "digests")
    table = df.sparkSession.createDataFrame(sorted(known.items()), "digest string, license string")
    lines = scanned.select("row", F.explode("lines").alias("digest")).join(table, "digest")
    found = lines.groupBy("row").agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    out = scanned.join(table, "digest", "left").join(found, "row", "left")
    return out.select(F.col("id").alias(id_col), "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def oracle_sql(texts: Iterable[tuple[str, str]] | None = None) -> str:
    """DuckDB SQL of scan_licenses over `documents`: the known texts go in whole and get their form from SQL."""

    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(c: str) -> str:
        s = f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        s = f"regexp_replace(replace({s}, '©', '(c)'), '[{MARKS}]', ' ', 'g')"
        edge = lit(EDGE.replace("\v", "").replace("\f", "").replace("\t", "").replace("\r", "")) + " || chr(9) || chr(11) || chr(12) || chr(13)"
        lines = f"array_to_string(list_transform(string_split({s}, chr(10)), lambda x: CASE WHEN trim(x, {edge}) = '' THEN chr(1) ELSE trim(x, {edge}) END), ' ')"
        s = rf"regexp_replace(regexp_replace({lines}, '[ \t\r\x0B\f]+', ' ', 'g'), {lit(NOTICE)}, ' \1\2', 'g')"
        s = rf"trim(regexp_replace(replace({s}, '&', ' and '), '[\x00-/:-@\[-`{{-\x7F]+', ' ', 'g'), ' ')"
        for a, b in SPELLINGS:
            s = f"replace({s}, {lit(a)}, {lit(b)})"
        return s

    rows = ", ".join(f"({lit(n)}, {lit(t)})" for n, t in (known_texts() if texts is None else texts))
    return rf"""
WITH raw(license, t) AS (VALUES {rows}), known AS (
  SELECT DISTINCT license, md5({form("t")}) AS digest FROM raw
), whole AS (
  SELECT doc_id, md5({form("text")}) AS digest FROM documents
), line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents
), found AS (
  SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list_distinct(list(license))), ',') AS notices FROM (SELECT doc_id, md5({form("x")}) AS digest FROM line) JOIN known USING (digest) GROUP BY doc_id
)
SELECT doc_id, whole.digest, license, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)"""
