"""Weekly counts of error signatures as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def weekly_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "2 days") -> DataFrame:
    """Events per key and ISO week; a week is final once the watermark has passed its end.

    Windows of seven days counted from the epoch begin on Thursdays; four days later is Monday.
    """
    week = F.window(ts, "7 days", "7 days", "4 days")
    return events.withWatermark(ts, late).groupBy(week.alias("week"), key).agg(
        F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("sessions")
    )


def write_weekly(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends finished weeks to a Parquet table, once the input at hand is read."""
    flat = counts.select(F.col("week.start").alias("monday"), *[c for c in counts.columns if c != "week"])
    return flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
