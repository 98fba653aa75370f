"""Excerpts around the densest hits of a text, with the hits marked. Runs over one page of results."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right


def best_location(hits: list[int], length: int) -> int:
    """The hit with most other hits near it, nearer ones counting more; the first on ties, 0 without hits.

    hits are sorted. Densities are compared to nine digits, so that the order of summing doesn't decide.
    """
    limit = length * 2 / 3
    best, top = 0, -1.0
    for k, p in enumerate(hits):
        lo, hi = bisect_left(hits, p - limit), bisect_right(hits, p + limit)
        density = round(sum(1 / (1 + math.log(abs(p - q))) for i, q in enumerate(hits[lo:hi], lo) if i != k), 9)
        if density > top:
            best, top = p, density
    return best


def hit_positions(text: str, token: re.Pattern, is_hit) -> list[int]:
    return [m.start() for m in token.finditer(text) if is_hit(m.group())]


def make_excerpt(text: str, hits: list[int], token_pattern: str, length: int = 150, open_tag: str = "<strong>", close_tag: str = "</strong>") -> str:
    """Cut a window about the best hit, trim it to words and sentences, and mark the hits."""
    if not text:
        return ""
    best = best_location(hits, length)
    start, stop = max(best - length, 0), min(best + length, len(text))
    cut = text[start:stop]
    size = len(cut)
    best -= start
    marks = [p - start for p in hits if 0 <= p - start < 2 * length]
    first_word = re.compile(rf"\A\W*(?:{token_pattern})(\W*)")
    last_word = re.compile(rf"(\W*)((?:{token_pattern})\W*)\Z")
    if best > 3 * size / 4:
        cut = cut[max(size - length, 0) :]
        if start:
            m = first_word.match(cut)
            if m:
                cut = cut[m.end() :]
            if not (m and "." in m[1]):
                cut = "... " + cut
        shift = size - len(cut)
    else:
        if best and start:
            m = re.compile(rf"\A\W*(?:{token_pattern})").match(cut)
            if m:
                cut = cut[m.end() :]
            chop = max(size - length if 2 * length > size else length, 0)
            stop_at = cut.rfind(".", 0, chop + 1)
            cut = cut[stop_at + 1 :] if stop_at >= 0 else "... " + cut
        shift = size - len(cut)
        cut = cut[: length + 20]
        m = last_word.search(cut)
        if m and best - shift + len(m[2]) != len(cut):
            cut = cut[: m.start()] + m[1]
    if not re.search(r"\.\s*\Z", cut):
        cut = re.sub(r"\W+\Z", " ...", cut)
    if open_tag:
        word = re.compile(token_pattern)
        for p in sorted((p - shift for p in marks), reverse=True):
            m = word.match(cut, p) if p >= 0 else None
            if m:
                cut = cut[:p] + open_tag + m[0] + close_tag + cut[m.end() :]
    return cut
