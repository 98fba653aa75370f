"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, URL schemes and cue words of addresses and accounts) in
one pass over a text; runs of digits are anchors too. From each anchor a deterministic local parser walks outwards to
the boundary of the item and validates it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "address", "account", "ident", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REST = re.compile(r"://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:[/?#][!-;=?-~]*)?")
_IBAN = re.compile(r"[:#\s]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:\s+(?:no\.?|number))?[:#\s]{1,3}([0-9][0-9-]{4,18}[0-9])(?![0-9])", re.I)
_SOCIAL = re.compile(r"(?:\s+(?:no\.?|number))?[:#\s]{1,3}(?!000|666|9)([0-9]{3}([ -]?)(?!00)[0-9]{2}\2(?!0000)[0-9]{4})(?![\w-])", re.I)
_PASSPORT = re.compile(r"(?:\s+(?:no\.?|number))?[:#\s]{1,3}([A-Z]{0,2}[0-9]{6,9})(?!\w)", re.I)
_ASSIGNED = re.compile(r"[\"']?\s{0,3}(?::|=|:=|=>)\s{0,3}([\"']?)([A-Za-z0-9+/_.~-]{12,}=*)(?(1)\1)")
_PREFIXED = re.compile(r"[A-Za-z0-9_-]*")
_HOUSE = re.compile(r"[0-9]{1,6}[A-Za-z]?")
_NAME = re.compile(r"[A-Z][\w'.-]*")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_SCHEMES = ("https", "http", "ftp")
_STREETS = ("street", "avenue", "road", "boulevard", "lane", "drive", "court", "square", "st.", "ave.", "rd.", "blvd.")
_ACCOUNTS = ("iban", "account", "acct")
_IDENTS = {"ssn": _SOCIAL, "social security": _SOCIAL, "passport": _PASSPORT}
_SECRETS = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key")
#: Fixed starts of issued keys, with the characters that follow at least.
_ISSUED = {"AKIA": 16, "ghp_": 36, "github_pat_": 22, "xoxb-": 20, "sk_live_": 16, "AIza": 35}
_WORD = re.compile(r"\w")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def iban(text: str) -> bool:
    """Check sum of an account number: moved front, letters as numbers, rest 1 by 97."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_span(text: str, start: int, stop: int) -> tuple[int, int] | None:
    """The longest stretch from start to a group boundary, at stop or before it, whose check sum holds."""
    while stop > start:
        if iban(text[start:stop]):
            return start, stop
        stop = text.rfind(" ", start, stop)
    return None


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    cues = [*((w, "address") for w in _STREETS), *((w, "account") for w in _ACCOUNTS), *((w, "ident") for w in _IDENTS), *((w, "assigned") for w in _SECRETS)]
    cased = [(form, kind) for w, kind in cues for form in (w, w.title(), w.capitalize(), w.upper())]
    for word, kind in [("@", "email"), ("+", "phone"), ("://", "url"), *cased, *((w, "issued") for w in _ISSUED)]:
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


_auto = None


def _house_start(text: str, at: int, floor: int) -> int | None:
    """Start of the house number before a street cue at `at`: a number, then one to four capitalised words. The words
    may be of any length; a number inside a longer word or number is none."""
    stop = at - 1
    for words in range(5):
        if stop < floor or text[stop] != " ":
            return None
        start = max(text.rfind(" ", floor, stop) + 1, floor)
        if words and _HOUSE.fullmatch(text, start, stop):
            return None if start and _WORD.match(text, start - 1) else start
        if not _NAME.fullmatch(text, start, stop):
            # the number may follow other marks than a space, as in "(12 Oak Street"
            m = _TAIL.search(text, max(start, stop - 8), stop) if words else None
            return m.start() if m else None
        stop = start - 1
    return None


#: A house number at the end of a word that begins with marks.
_TAIL = re.compile(r"(?<!\w)[0-9]{1,6}[A-Za-z]?\Z")


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of every kind in a text, sorted, not overlapping within a kind."""
    global _auto
    if _auto is None:
        _auto = _automaton()
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    last = dict.fromkeys(KINDS, 0)
    for end, (kind, n) in _auto.iter(text):
        at, floor = end - n + 1, last.get(kind, 0)
        if at < floor:
            continue
        span = None
        if kind == "email":
            m = _DOMAIN.match(text, at)
            if m:
                start = at
                while start > floor and not _NOT_LOCAL.match(text, start - 1):
                    start -= 1
                if start < at:
                    span = (start, m.end())
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m:
                last[kind] = m.end()
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out[kind].append(m.span())
            continue
        elif kind == "url":
            m = _REST.match(text, at)
            scheme = next((x for x in _SCHEMES if text[max(0, at - len(x)) : at].lower() == x), "")
            before = at - len(scheme)
            if m and scheme and not (before and _WORD.match(text, before - 1)):
                stop = m.end()
                while text[stop - 1] in ".,;:!?)'\"":
                    stop -= 1
                span = (before, stop)
        elif kind == "address":
            if not _WORD.match(text, end + 1):
                start = _house_start(text, at, floor)
                span = None if start is None else (start, end + 1)
        elif kind == "issued":
            kind, floor = "secret", last["secret"]
            if at >= floor and not (at and _WORD.match(text, at - 1)):
                stop = _PREFIXED.match(text, end + 1).end()
                span = (at, stop) if stop - end - 1 >= _ISSUED[text[at : end + 1]] else None
        elif kind == "assigned":
            kind = "secret"
            m = _ASSIGNED.match(text, end + 1)
            if m and m.start(2) >= last["secret"] and any(c.isdigit() for c in m.group(2)):
                span = m.span(2)
        elif not _WORD.match(text, end + 1):
            if kind == "ident":
                m = _IDENTS[text[at : end + 1].lower()].match(text, end + 1)
                span = m and m.span(1)
            else:
                m = _IBAN.match(text, end + 1)
                span = m and _iban_span(text, *m.span(1))
                m = None if span else _NUMBER.match(text, end + 1)
                if m:
                    span = m.span(1)
        if span:
            out[kind].append(span)
            last[kind] = span[1]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(run.group()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out["ip"].append((run.start() + m.start(), run.start() + m.end()))
    return out


def _joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def _scan(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = [find_spans(t or "") for t in batch.column(1).to_pylist()]
        base = [hashlib.sha256(_joined(f, BASE).encode()).hexdigest() for f in found]
        counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
        columns = [batch.column(0), *counts, pa.array(base, pa.string()), pa.array([_joined(f, KINDS) for f in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_url, n_address, n_account, n_ident, n_secret, base_sha256, spans) of every
    document. ident is a number after a cue of social security or passports, secret a key after a cue or an issued start.

    Whole texts are read; a null or empty text has no spans and the digest of the empty string. Rows pass through one
    by one: repeated rows give equal rows, an empty table an empty result, and only the two named columns are read.
    """
    kind = dict(df.dtypes)[id_col]
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, f"id {kind}, {counts}, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def _mask(name: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(name)
            masked = []
            for t in batch.column(at).to_pylist():
                if t:
                    spans = sorted((a, b, k) for k, v in find_spans(t).items() for a, b in v)
                    parts, end = [], 0
                    for a, b, k in spans:
                        if a >= end:
                            parts += [t[end:a], f"<{k}>"]
                        end = max(end, b)
                    t = "".join([*parts, t[end:]])
                masked.append(t)
            yield batch.set_column(at, name, pa.array(masked, batch.schema.field(at).type))

    return run


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span in text_col replaced by its kind in angle brackets; of overlapping spans the first names the
    kind. Null stays null and empty stays empty; other columns pass as they are, whatever their names; repeated rows
    give equal rows, an empty table an empty result."""
    return df.mapInArrow(_mask(text_col), df.schema)
