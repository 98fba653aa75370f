"""Fields of an index: what is stored, scored, weighted and how text becomes terms."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

RESERVED = {"score", "excerpt", "aggscore", "datetime", "sortstring"}
AUTOMATIC = {"doc_id", "doc_mdfive", "doc_num"}


@dataclass(frozen=True)
class FieldDef:
    """One text field. Defaults: stored and scored with weight 1, taken whole, case kept, not stemmed."""

    name: str
    store: bool = True
    score: bool = True
    weight: float = 1.0
    tokenize: bool = False
    stem: bool = False
    lowercase: bool = False


@dataclass
class IndexSchema:
    """Fields in order of definition; frozen once the first document is added."""

    fields: dict[str, FieldDef] = field(default_factory=dict)
    language: str = ""
    stoplist: list[str] | None = None
    phrase_matching: bool = True
    enable_datetime: bool = False
    enable_sortstring: int = 0
    stop_unstemmed: bool = False
    frozen: bool = False

    def define_field(self, name: str, **flags) -> IndexSchema:
        if self.frozen:
            raise ValueError("fields can't be defined once documents were added")
        if not re.fullmatch(r"[a-zA-Z_]+", name or ""):
            raise ValueError(f"illegal field name {name!r}")
        if name in RESERVED or name in AUTOMATIC:
            raise ValueError(f"field name {name!r} is reserved")
        if name in self.fields:
            raise ValueError(f"field {name!r} is defined already")
        unknown = set(flags) - set(FieldDef.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        self.fields[name] = FieldDef(name, **flags)
        return self

    @property
    def scored(self) -> list[FieldDef]:
        return [self.fields[k] for k in sorted(self.fields) if self.fields[k].score]

    @property
    def stored(self) -> list[str]:
        return sorted(k for k, f in self.fields.items() if f.store)

    @property
    def total_weight(self) -> float:
        """Sum of the weights of all scored fields: the divisor of every aggregate score."""
        return sum(f.weight for f in self.scored)

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> IndexSchema:
        d = dict(d)
        d["fields"] = {k: FieldDef(**v) for k, v in d["fields"].items()}
        return IndexSchema(**d)
