"""Shared storage and small helpers of the training-data operators.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``; every executor sees it, so a lost executor costs a
task retry and never the data.  Where the setting is absent a local master
(tests) gets a folder of its own, and anything else an error.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="cantus-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: workers live on and share an executor's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the bytes of an Arrow batch, which by default may hold 10,000 texts or 64 MB; a lower bound stays."""
    if int(str(spark.conf.get(_BATCH)).rstrip("b")) > most:
        spark.conf.set(_BATCH, str(most))


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps, which stay until the driver collects its garbage."""
    for _ in range(2):  # what the first round frees may hold on to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def save(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, which cuts its lineage."""
    release(df.sparkSession)
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_table(df: DataFrame, part: str | None = None) -> None:
    """Deletes a table that ``save`` wrote, or one of its partitions (``column=value``), that no later step reads."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        while not re.search(r"-[0-9a-f]{12}$", path.getName()):
            path = path.getParent()
        gone = spark._jvm.org.apache.hadoop.fs.Path(path, part) if part else path
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def id_remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo ``mod``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(mod))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
