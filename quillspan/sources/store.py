"""An index on shared storage: immutable segment folders, versioned metadata, one pointer that moves.

Layout under the root: docs/seg=N, postings/seg=N (counts, in runs sorted by term), tombs/t=N (numbers of replaced and deleted
documents), meta/V.json and CURRENT. Readers follow CURRENT and keep a consistent snapshot; a writer holds LOCK. What
neither the current version nor the one before names is deleted with each commit, and the one before as the next commit
begins, so a reader outlives one commit.
"""

from __future__ import annotations

import json
import os
import socket
import time
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Language
from ..operators.compaction import segments_to_merge
from ..operators.postings import DATE_TYPE, POSTING_FILES, doc_stats, make_counts, make_docs, with_lengths
from ..operators.search import Index
from ..plans.schema import IndexSchema
from .document import Document
from .scratch import without_ids


#: Row group of stored documents: what a page lookup reads for a hit, and the least that a task analyses.
DOC_FILES = {"parquet.block.size": 4 << 20, "compression": "zstd"}


class Files:
    """The few file operations that an index needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = False) -> None:
        stream = self.fs.create(self.path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside and rename over, so that readers see the old or the new content."""
        self.write(f"{name}.new", text, True)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri() if "://" in self.root else self.fs.getUri())
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        context.rename(self.fs.makeQualified(self.path(f"{name}.new")), self.fs.makeQualified(self.path(name)), array)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


    def names(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.path(folder))] if self.exists(folder) else []


def lock_owner(spark: SparkSession, root: str) -> dict | None:
    """Who holds the writer's lock: host, process, Spark application and seconds since it was taken; None if free."""
    files = Files(spark, root)
    if not files.exists("LOCK"):
        return None
    text = files.read("LOCK")
    owner = json.loads(text) if text else {}
    return {**owner, "age": time.time() - owner["since"]} if "since" in owner else owner


def break_lock(spark: SparkSession, root: str, older_than: float = 0.0) -> bool:
    """Remove the lock of a writer that ended without closing, if it is at least so many seconds old; true if removed.

    A file system that many executors share has no lock that ends with its holder's process. Break one only once its
    application (see lock_owner) is gone: nothing a writer does before it publishes is visible, so none of it is lost
    but its uncommitted documents.
    """
    owner = lock_owner(spark, root)
    if owner is None or owner.get("age", older_than) < older_than:
        return False
    Files(spark, root).delete("LOCK")
    return True


def read_meta(files: Files) -> dict | None:
    if not files.exists("CURRENT"):
        return None
    return json.loads(files.read(f"meta/{files.read('CURRENT').strip()}.json"))


def _load(spark: SparkSession, root: str, meta: dict, table: str, segments: Iterable[int]) -> DataFrame | None:
    paths = [f"{root}/{table}/seg={s}" for s in segments]
    return spark.read.option("basePath", f"{root}/{table}").parquet(*paths).drop("seg") if paths else None


def _tombs(spark: SparkSession, root: str, meta: dict) -> DataFrame | None:
    paths = [f"{root}/tombs/t={t}" for t in meta["tombs"]]
    return spark.read.option("basePath", f"{root}/tombs").parquet(*paths).select("doc_num") if paths else None


def open_index(spark: SparkSession, root: str, lang: Language | None = None, cache_postings: bool = False) -> Index:
    """The current version of an index. cache_postings keeps its postings in the executors' memory between searches."""
    root = root.rstrip("/")
    meta = read_meta(Files(spark, root))
    if meta is None:
        raise FileNotFoundError(f"no index at {root}")
    segments = [s["id"] for s in meta["segments"]]
    docs, postings = (_load(spark, root, meta, t, segments) for t in ("docs", "postings"))
    tombs = _tombs(spark, root, meta)
    if tombs is not None:
        number = tombs.count()
        docs, postings = (without_ids(df, "doc_num", tombs, number) for df in (docs, postings))
    if cache_postings:
        # what memory can't hold is read again: it lies on disk already
        postings = postings.persist(StorageLevel.MEMORY_ONLY)
    schema = IndexSchema.from_dict(meta["schema"])
    return Index(schema, docs.drop("added", *[f"n_{f.name}" for f in schema.scored]), postings, lang, meta["num_docs"], stats=doc_stats(docs, schema))


class IndexWriter:
    """Adds, replaces and deletes documents and publishes them as a new version.

    mode overwrite starts anew, update keeps what is there. optimization is the compaction level, 1 to 4.
    """

    def __init__(self, spark: SparkSession, root: str, mode: str = "update", optimization: int = 2, lang: Language | None = None, max_records_per_file: int = 0, **settings) -> None:
        if mode not in ("overwrite", "update"):
            raise ValueError(f"mode {mode!r}")
        segments_to_merge(optimization, [])
        self.spark, self.root, self.mode, self.level, self.lang = spark, root.rstrip("/"), mode, optimization, lang
        self.files = Files(spark, root)
        owner = {"host": socket.gethostname(), "pid": os.getpid(), "application": spark.sparkContext.applicationId, "since": time.time()}
        try:
            self.files.write("LOCK", json.dumps(owner))
        except Exception as e:
            raise RuntimeError(f"another writer holds {self.root}/LOCK: {lock_owner(spark, root)}; break_lock() removes one left behind") from e
        self.open = True
        self.max_records = max_records_per_file
        old = read_meta(self.files)
        self.version = old["version"] if old else 0
        self.before = old
        self.meta = old if old and mode == "update" else None
        unknown = set(settings) - {"language", "stoplist", "phrase_matching", "enable_datetime", "enable_sortstring", "stop_unstemmed"}
        if unknown:
            self.close()
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        if self.meta:
            self.schema = IndexSchema.from_dict(self.meta["schema"])
        else:
            self.schema = IndexSchema(**settings)
            first = (max([s["id"] for s in old["segments"]], default=-1) + 1) if old else 0
            self.meta = {"segments": [], "tombs": [], "next_seg": old["next_seg"] if old else first, "next_doc": 0, "num_docs": 0, "batches": {}}
        self.added: list[DataFrame] = []
        self.numbered: set[int] = set()
        self.deleted: list[tuple[DataFrame, int]] = []
        self.single: list[Document] = []

    def define_field(self, name: str, **flags) -> IndexWriter:
        self.schema.define_field(name, **flags)
        return self

    def add_documents(self, df: DataFrame, id_col: str, columns: Mapping[str, str] | None = None, dt: str | Column | None = None, sortstring: str | Column | None = None, doc_num: str | Column | None = None) -> IndexWriter:
        """Add or replace one document for each row; of rows with the same id the last stays."""
        self.schema.frozen = True
        # each call numbers its rows after those of earlier calls
        base = self.meta["next_doc"] + (len(self.added) << 52 if doc_num is None else 0)
        if doc_num is not None:
            self.numbered.add(len(self.added))
        # the call's number tells which deletions of the session came later
        self.added.append(make_docs(df, self.schema, id_col, columns, dt, sortstring, doc_num, base).withColumn("added", F.lit(len(self.added))))
        return self

    def new_doc(self, doc_id) -> Document:
        return Document(str(doc_id))

    def add_doc(self, doc: Document) -> IndexWriter:
        """Add or replace one document; those added this way go into one table at the commit."""
        unknown = set(doc.fields) - set(self.schema.fields)
        if unknown:
            raise ValueError(f"fields {sorted(unknown)} aren't defined")
        if doc.datetime and not self.schema.enable_datetime:
            raise ValueError("the index has no datetimes")
        self.schema.frozen = True
        self.single.append(doc)
        return self

    def doc_is_indexed(self, doc_id) -> bool:
        """Whether the index holds the id as this session leaves it: published or added, and not deleted since."""
        return self._stored(doc_id) is not None

    def _stored(self, doc_id) -> dict | None:
        """Stored fields of the id's document as this session leaves it."""
        key, digest = str(doc_id), F.md5(F.lit(str(doc_id)))
        for d in reversed(self.single):
            if d.doc_id == key:
                return {f: d.get_field(f) or "" for f in self.schema.stored}
        # the last deletion of the id hides what was there before it
        since = max((k for d, k in self.deleted if d.where(F.col("doc_md5") == digest).limit(1).count()), default=-1)
        pending = [a.where(F.col("doc_md5") == digest) for k, a in reversed(list(enumerate(self.added))) if k >= since]
        if self.meta["segments"] and since < 0:
            pending.append(open_index(self.spark, self.root).docs.where(F.col("doc_md5") == digest))
        for found in pending:
            row = found.orderBy(F.desc("doc_num")).select(*[F.col(f"f_{f}").alias(f) for f in self.schema.stored], "doc_num").first()
            if row:
                return {f: row[f] for f in self.schema.stored}
        return None

    def delete_doc(self, doc_id) -> dict | None:
        """Delete one document and return its stored fields, None if there is none."""
        stored = self._stored(doc_id)
        if stored is not None:
            self.delete_documents([doc_id])
        return stored

    def delete_documents(self, ids: DataFrame | Iterable) -> IndexWriter:
        """Delete by id: a DataFrame of one column, or some ids. Documents of this session that were added before go
        as well; those added afterwards stay."""
        if not isinstance(ids, DataFrame):
            some = {str(i) for i in ids}
            self.single = [d for d in self.single if d.doc_id not in some]
            ids = self.spark.createDataFrame([(i,) for i in sorted(some)], "id string")
        else:
            self._gather_single()
        gone = ids.select(F.md5(F.col(ids.columns[0]).cast("string")).alias("doc_md5"))
        # those with numbers of their own go at once, as their numbers may come again; the rest is buried by the commit
        self.added = [without_ids(a, "doc_md5", gone).select(a.columns) if k in self.numbered else a for k, a in enumerate(self.added)]
        self.deleted.append((gone, len(self.added)))
        return self

    def _gather_single(self) -> None:
        """The documents added one by one as one more table."""
        if self.single:
            names = list(self.schema.fields)
            rows = [(d.doc_id, d.datetime or (0,) * 6, d.sortstring, *[d.get_field(n) for n in names]) for d in self.single]
            shape = f"__id string, __dt {DATE_TYPE}, __sort string, " + ", ".join(f"{n} string" for n in names)
            self.single = []
            self.add_documents(self.spark.createDataFrame(rows, shape).coalesce(1), "__id", None, "__dt", "__sort")

    def commit(self, batch: tuple[str, int] | None = None) -> dict:
        """Write the new segment, merge those that the level names, publish and release the lock.

        batch (stream name, number) makes a repeated micro-batch a no-op.
        """
        if not self.open:
            raise RuntimeError("this writer is closed")
        meta = dict(self.meta)
        self._gather_single()
        if batch and meta["batches"].get(batch[0], -1) >= batch[1]:
            self.close()
            return meta
        # the version before the current one has outlived a commit; so two versions at most lie here at once
        self._purge(self.before)
        seg, segments = meta["next_seg"], meta["segments"]
        merge = segments_to_merge(self.level, [s["live"] for s in segments]) if segments and self.added else []
        merged, kept = [segments[k]["id"] for k in merge], [s for k, s in enumerate(segments) if k not in merge]
        spark, root = self.spark, self.root
        fresh = None
        gone = [d for d, _ in self.deleted]
        paths = [f"{root}/docs/seg={s['id']}" for s in segments]
        old = spark.read.option("basePath", f"{root}/docs").parquet(*paths).select("doc_num", "doc_md5", "seg") if paths else None
        dead = _tombs(spark, root, meta)
        if dead is not None and old is not None:
            old = old.join(dead, "doc_num", "left_anti")
        buried: list[DataFrame] = []
        lost: dict[int, int] = {}
        if self.added:
            self._write(with_lengths(reduce(DataFrame.unionByName, self.added), self.schema, self.lang), f"docs/seg={seg}")
            fresh = spark.read.parquet(f"{root}/docs/seg={seg}")
            # of rows with one id all but the last are buried at once: no shuffle of texts
            last = fresh.groupBy("doc_md5").agg(F.max("doc_num").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            buried.append(fresh.select("doc_num", "doc_md5").join(last, "doc_md5").where("doc_num < last").select("doc_num", F.lit(seg).alias("seg")))
            for ids, k in self.deleted:
                if k:
                    buried.append(fresh.where(F.col("added") < k).join(ids, "doc_md5", "left_semi").select("doc_num", F.lit(seg).alias("seg")))
            gone.append(fresh.select("doc_md5"))
        if gone and old is not None:
            buried.append(old.join(reduce(DataFrame.union, gone).distinct(), "doc_md5", "left_semi").select("doc_num", F.col("seg").cast("int").alias("seg")))
        tombs = list(meta["tombs"]) if len(merged) < len(segments) else []
        if buried:
            reduce(DataFrame.union, buried).distinct().write.mode("overwrite").parquet(f"{root}/tombs/t={seg}")
            lost = {r.seg: r["count"] for r in spark.read.parquet(f"{root}/tombs/t={seg}").groupBy("seg").count().collect()}
            if lost:
                tombs.append(seg)
                dead = _tombs(spark, root, {"tombs": [*meta["tombs"], seg]})
            else:  # readers then need no join
                self.files.delete(f"tombs/t={seg}")
        if fresh is not None:
            number = dead.count() if dead is not None else 0
            live = without_ids(fresh, "doc_num", dead, number) if number else fresh
            postings = make_counts(live.drop(*[f"n_{f.name}" for f in self.schema.scored]), self.schema, self.lang)
            if merged:
                part = {t: _load(spark, root, meta, t, merged) for t in ("docs", "postings")}
                if number:
                    part = {t: without_ids(df, "doc_num", dead, number) for t, df in part.items()}
                self._write(part["docs"].select(fresh.columns), f"docs/seg={seg}", "append")
                postings = postings.unionByName(part["postings"])
            self._write(postings, f"postings/seg={seg}")
            kept = [*kept, {"id": seg, "live": 0}]
        ids = [s["id"] for s in kept]
        # segments that stay lose what was buried just now; only what was written just now is counted
        counts = {s["id"]: s["live"] - lost.get(s["id"], 0) for s in kept}
        top = 0
        if fresh is not None:
            n, most = spark.read.parquet(f"{root}/docs/seg={seg}").select("doc_num").agg(F.count(F.lit(1)), F.max("doc_num")).first()
            counts[seg] = n - lost.get(seg, 0)
            top = (most or 0) + 1
        meta = {
            "version": self.version + 1,
            "schema": self.schema.to_dict(),
            "segments": [{"id": i, "live": counts[i]} for i in ids],
            "tombs": tombs,
            "next_seg": seg + 1,
            "next_doc": max(meta["next_doc"], top),
            "num_docs": sum(counts.values()),
            "batches": {**meta["batches"], **({batch[0]: batch[1]} if batch else {})},
        }
        self.files.write(f"meta/{meta['version']}.json", json.dumps(meta), True)
        self.files.replace("CURRENT", str(meta["version"]))
        self._purge(meta)
        self.close()
        return meta

    def _write(self, df: DataFrame, name: str, mode: str = "overwrite") -> None:
        writer = df.write.mode(mode).options(**(POSTING_FILES if name.startswith("postings/") else DOC_FILES))
        if self.max_records:
            writer = writer.option("maxRecordsPerFile", self.max_records)
        writer.parquet(f"{self.root}/{name}")

    def _purge(self, meta: dict | None) -> None:
        """Delete what neither this version nor the one before the session names: merged and overwritten segments, old tombstones."""
        named = [m for m in (meta, self.before) if m]
        segments = {f"seg={s['id']}" for m in named for s in m["segments"]}
        keep = {"docs": segments, "postings": segments, "tombs": {f"t={t}" for m in named for t in m["tombs"]}, "meta": {f"{m['version']}.json" for m in named}}
        for folder, names in keep.items():
            for name in self.files.names(folder):
                if name not in names and not name.startswith((".", "_")):
                    self.files.delete(f"{folder}/{name}")

    def close(self) -> None:
        """Give up what isn't committed and release the lock."""
        if self.open:
            self.files.delete("LOCK")
            self.open = False

    def __enter__(self) -> IndexWriter:
        return self

    def __exit__(self, *error) -> None:
        self.close()
