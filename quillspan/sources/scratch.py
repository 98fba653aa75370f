"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Document numbers up to which a list is broadcast: 16 bytes each in a hashed relation.
BROADCAST_IDS = 2_000_000

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: what spark.checkpoint.dir or the context names. Only a session on this machine
    alone (tests) gets a folder of its own; on a cluster executors could not share one, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir() or _own.get(context.applicationId)
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillspan-")
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, lost executors cost no rerun."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def without_ids(df: DataFrame, key: str, drop: DataFrame, count: int | None = None) -> DataFrame:
    """df without the rows whose key is in drop (one column of that name). Lists of up to BROADCAST_IDS, by count or counted, are
    broadcast, so that no text is shuffled."""
    small = (drop.count() if count is None else count) <= BROADCAST_IDS
    return df.join(F.broadcast(drop) if small else drop, key, "left_anti")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables written inside it, but for those handed to the function that it gives."""
    _scopes.append([])

    def keep(table: DataFrame) -> DataFrame:
        _scopes[-1].remove(table._scratch_path)
        return table

    try:
        yield keep
    finally:
        for path in _scopes.pop():
            remove(spark, path)
