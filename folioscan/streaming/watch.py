"""The same plans over files as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

_FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, path: str, at_once: int = 1000) -> DataFrame:
    """New files of a folder, at most at_once in a batch."""
    return spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", at_once).load(path)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies a plan to all that is there, batch by batch, and stops; a rerun goes on where it stopped."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
