"""Structured Streaming: deduplicated ingest, windowed activity, catalog maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(rows: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Rows with a key that was not seen within the watermark; the state is bounded by ``delay``."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def activity(rows: DataFrame, ts: str, window: str, *by: str, delay: str = "1 hour") -> DataFrame:
    """Counts by tumbling window, closed by the watermark."""
    grouped = rows.withWatermark(ts, delay).groupBy(F.window(ts, window), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def upserting(rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into a table; ``write`` gets the batch number so that a repeated batch replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        write(merge(read(), batch), number)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Append all available rows to Parquet and stop."""
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
