"""Full-text retrieval and ranking on Spark DataFrames."""

import logging

from .functions.analysis import LANGUAGES, Language, language
from .operators.search import Index, Searcher
from .plans.query import Query
from .plans.schema import FieldDef, IndexSchema
from .sources.document import Document
from .sources.store import IndexWriter, break_lock, lock_owner, open_index

log = logging.getLogger("quillspan")


def verbosity(level: int | None = None) -> int:
    """The library's log level; with an argument, set it."""
    if level is not None:
        log.setLevel(level)
    return log.level


__all__ = ["Document", "verbosity", "LANGUAGES", "FieldDef", "Index", "IndexSchema", "IndexWriter", "Language", "Query", "Searcher", "break_lock", "language", "lock_owner", "open_index"]
