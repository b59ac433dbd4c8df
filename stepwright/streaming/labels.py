"""A stream of labelled records: files arrive, are labelled once each, and are appended.

The checkpoint takes the place of counting output lines: a restarted query goes on after the last
committed batch, and a batch that is repeated overwrites what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_arrivals(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """Record files as a stream, with the time of arrival."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return stream.withColumn("arrived_at", F.col("_metadata.file_modification_time"))


def label_stream(arrivals: DataFrame, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str], within: str = "1 day") -> StreamingQuery:
    """Label each key once within the watermark and write Parquet per batch; runs what is there."""
    fresh = arrivals.withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, number: int) -> None:
        label(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_profile(events: DataFrame, time: str, tag: str, value: str, window: str, late: str) -> DataFrame:
    """Calls and summed value per tag and window of event time, with a bound on lateness."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), tag).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total"))
