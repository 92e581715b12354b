"""Helpers that the training-data operators share: stored intermediates, worker caches and input columns."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the substring and near-duplicate operators, as Java and Python regular expressions read them alike.
WORD = "[^\x20\x09-\x0d]+"


#: The largest Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds Arrow batches by bytes, from now on and for the whole session: 10,000 rows may be texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only in local mode (tests), where it is unset, a temporary one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, own, True)
        where = "file://" + own
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: The folders that stored() wrote in this process.
WRITTEN: list[str] = []


def clear(spark: SparkSession) -> int:
    """Removes all that stored() wrote in this process, wherever it lies, and gives the number of folders.

    For after a result is written: results are lazy and read these folders.
    """
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(WRITTEN)
    while WRITTEN:
        place = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        place.getFileSystem(conf).delete(place, True)
    return n


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, and every later pass sees the same rows.

    Void columns (a column of untyped nulls) become strings, as Parquet has no such type.
    """
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(key: tuple, make: Callable[[], Any]) -> Any:
    """make()'s result, which a Python process keeps until it is asked for another one of the same kind, key's first entry."""
    holder = sys.modules.setdefault("_gridloom_worker", types.ModuleType("_gridloom_worker"))
    cache: dict[str, tuple[tuple, Any]] = holder.__dict__.setdefault("cache", {})
    if key[0] not in cache or cache[key[0]][0] != key:
        cache.pop(key[0], None)
        cache[key[0]] = key, make()
    return cache[key[0]][1]


def release() -> None:
    """Gives memory that a batch has freed back to the system: Spark keeps its Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_key(text: Column) -> Column:
    """128 bits of a whole text, in Spark's own functions: a pass that joins by it needs no Python worker for that."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def unused(columns: list[str]) -> str:
    """A prefix that none of the columns has, for temporary ones beside them."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
