"""Single documents built by hand, for callers that have a few rather than a DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Document:
    """One document: an id, text fields, and optionally a date key and a sort key."""

    doc_id: str
    fields: dict[str, str] = field(default_factory=dict)
    datetime: tuple[int, ...] | None = None
    sortstring: str | None = None

    def set_field(self, name: str, value: str | None) -> Document:
        """Set a field's text; None is empty, runs of white space become one space."""
        self.fields[name] = re.sub(r"[ \t\n\x0b\f\r]+", " ", value or "").strip(" ")
        return self

    def get_field(self, name: str) -> str | None:
        return self.fields.get(name)

    def set_datetime(self, *parts: int) -> Document:
        """Year, month, day, hour, minute and second; any numbers, compared in this order."""
        if len(parts) != 6 or not all(isinstance(p, int) for p in parts):
            raise ValueError("a datetime takes six whole numbers")
        self.datetime = parts
        return self

    def set_sortstring(self, value: str) -> Document:
        self.sortstring = value
        return self
