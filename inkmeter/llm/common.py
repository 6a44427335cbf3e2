"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: blank, tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows of a key table (one or two longs a row) that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session.

    Where none is set, a temporary one serves a session whose tasks run on the driver's machine; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """For applications over long texts: batches of at most 8 MB go to Python, which bounds the workers' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def release() -> None:
    """At the end of a task in Python: memory that it freed goes back to the system, as the worker process lives on."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: later reads survive a lost executor, and its lineage ends."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the broadcast hint if a count shows that it has at most ``rows`` rows, else as it is.

    ``df`` should be checkpointed or cheap, as it is counted first.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and hash of the text are not in ``gone`` (doc_id, h); a null doc_id is an id like others.

    Texts move only if ``gone`` is large.
    """
    keys = small(gone.select(F.col("doc_id").alias("_gone_id"), F.col("h").alias("_gone_h")).distinct())
    same = docs["doc_id"].eqNullSafe(keys["_gone_id"]) & (F.xxhash64(docs["text"]) == keys["_gone_h"])
    return docs.join(keys, same, "left_anti")


def unsigned(text: Column) -> Column:
    """crc32 of a text's UTF-8 bytes, unsigned."""
    return F.crc32(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from: crc32 of the id as text leaves 1 modulo 3.  A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def some(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` values of ``key``, those with the smallest hash: a bounded sample that reruns repeat."""
    return df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(rows)
