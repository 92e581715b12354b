"""Tiles as a stream: new files of tiles are worked on as they arrive, each once by the stream's own checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def work_on_arrival(spark: SparkSession, path: str, schema: str, checkpoint: str, work: Callable[[DataFrame], None], *, files_each: int = 64) -> StreamingQuery:
    """Starts a query that gives every micro-batch of new Parquet files to work, and ends when all present files are done.

    A batch that fails is given again, so work must be repeatable.
    """
    arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)
    return arrived.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda part, _: work(part)).start()
