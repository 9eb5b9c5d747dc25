"""Shared helpers of the training-data operators: stable keys, shared storage, words."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: dict[str, str] = {}

#: Setting that lets shuffle files go when the query that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows that Spark hands to a Python worker at once while a staged table is written.
_BATCH_ROWS = 2000

#: Tables staged in the innermost ``scratch`` block.
_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)

#: Words everywhere in this subpackage: maximal runs without space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` of the session. Only a local master (tests) may go
    without: it gets a temporary folder, since there driver and executors are one process.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIR:
        _LOCAL_DIR[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="veilframe-")
    return _LOCAL_DIR[sc.applicationId]


def per_worker(key: tuple, make):
    """``make()`` once per Python worker process, whichever tasks it runs; caches live there.

    A worker holds one such value: asking for another drops it, so that operators that
    run one after the other do not add up. Those without a value ask with ``nothing``.
    """
    store = sys.modules.setdefault("_veilframe_per_worker", types.ModuleType("_veilframe_per_worker"))
    if getattr(store, "key", None) != key:
        store.key = store.value = None
        release()
        store.key, store.value = key, make()
    return store.value


def nothing() -> None:
    """Drop what the worker holds from the operator before: it may be reused with that in memory."""
    per_worker(("nothing",), lambda: None)


def release() -> None:
    """Give freed memory of this process back to the system; Arrow and the C library keep it else."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and return a scan of it.

    Cuts the lineage: a lost executor costs a reread, not a recomputation. The write runs
    in a clone of the session in which its shuffle files, which nothing reads again, go at
    its end instead of filling the executors' disks, and Python gets small batches; the
    session's own settings stay. The
    written files go by ``drop``, at the end of the ``scratch`` block around, or with the
    driver's JVM.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    clone = spark._jsparkSession.cloneSession()
    clone.conf().set(_CLEANUP, "true")
    clone.conf().set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_BATCH_ROWS))
    jvm.org.apache.spark.sql.classic.Dataset.ofRows(clone, df._jdf.queryExecution().logical()).write().parquet(path)
    _files(spark, path).deleteOnExit(jvm.org.apache.hadoop.fs.Path(path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if (mine := _SCRATCH.get()) is not None:
        mine.append(out)
    return out


def _files(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader is done; other frames are left alone."""
    for df in tables:
        if path := getattr(df, "staged_at", None):
            spark, df.staged_at = df.sparkSession, None
            _files(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


#: Rows of a few keys each, tens of bytes, that may be sent to every executor (some 20 MB there).
SEND_ROWS = 300_000


def sendable(df: DataFrame) -> DataFrame:
    """A staged table of keys, to be sent to every executor if it has few rows; else a join deals out both sides."""
    return F.broadcast(df) if df.count() <= SEND_ROWS else df


@contextmanager
def scratch():
    """Tables staged within the block go at its end, but for those handed to the function it yields."""
    mine: list = []

    def keep(df: DataFrame) -> DataFrame:
        mine[:] = [x for x in mine if x is not df]
        if outer is not None:
            outer.append(df)
        return df

    outer = _SCRATCH.get()
    token = _SCRATCH.set(mine)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        drop(*mine)


#: Rows and bytes of a batch's texts that become Python objects at once.
SLICE_ROWS, SLICE_BYTES = 500, 4 << 20


def slices(batches):
    """The batches in parts of few rows and bytes; one text longer than the bytes is a part of its own."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file on this machine; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def on_worker(path: str) -> str:
    """``path`` where this machine has it, else this machine's own copy of the public tokenizer file of that name."""
    return path if os.path.exists(path) else tokenizer(os.path.basename(path))


def crc_fold(doc_id, folds: int):
    """crc32 of the decimal doc_id, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))
