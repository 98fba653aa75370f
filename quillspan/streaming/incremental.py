"""Incremental indexing of a stream: each micro-batch is one commit, replayed batches change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import IndexWriter


def index_stream(stream: DataFrame, root: str, name: str, id_col: str, define: Callable[[IndexWriter], None], optimization: int = 3, dt: str | None = None, columns: dict[str, str] | None = None, **settings) -> DataStreamWriter:
    """A stream writer that upserts every micro-batch into the index at root.

    define sets the fields of a new index. The batch number is stored with the commit under the stream's name, so a
    batch that is run again after a failure is left out.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        with IndexWriter(batch.sparkSession, root, "update", optimization, **settings) as w:
            if not w.schema.fields:
                define(w)
            w.add_documents(batch, id_col, columns, dt)
            w.commit((name, number))

    return stream.writeStream.foreachBatch(upsert)
