"""Daily increments as a stream: an extension of the batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events for each day and source, finished once the watermark has passed the day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows whose key wasn't seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def publish_increments(stream: DataFrame, checkpoint: str, upsert) -> StreamingQuery:
    """Runs what has arrived as micro-batches and stops; upsert(df, batch_id) must be idempotent."""
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
