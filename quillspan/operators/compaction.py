"""Which segments a new commit rewrites, by compaction level."""

from __future__ import annotations


def segments_to_merge(level: int, docs: list[int]) -> list[int]:
    """Places of the segments to merge with the new documents; docs: live documents of each segment, oldest first.

    1 merges everything; 2 keeps a large first segment and a small second one, which is rewritten until it outgrows a
    tenth of the first; 3 appends up to ten segments, then merges the tail that no longer falls off steeply; 4 appends.
    """
    if level not in (1, 2, 3, 4):
        raise ValueError(f"optimization level {level!r}")
    if level == 1:
        return list(range(len(docs)))
    if level == 2:
        if len(docs) < 2:
            return []
        if len(docs) > 2 or docs[1] > docs[0] / 10:
            return list(range(len(docs)))
        return [1]
    if level == 3 and len(docs) >= 10:
        k = 0
        while k < len(docs) and sum(docs[k : k + 10]) <= docs[k]:
            k += 1
        return list(range(k, len(docs)))
    return []
