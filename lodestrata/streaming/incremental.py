"""Incremental runs: new files only, restart after a failure, and event-time windows (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.upsert import accepted, checked, dead_letters


def new_files(spark: SparkSession, path: str, schema: str, format: str = "json", **options: str) -> DataFrame:
    """A stream of the files of a folder that no run has taken yet."""
    return spark.readStream.schema(schema).options(**options).format(format).load(path)


def run_available(df: DataFrame, output: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Process what is there, append it as Parquet, and stop. A file counts as done once its batch is committed, so a failed run repeats it whole."""
    query = transform(df).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_checked(df: DataFrame, checks: dict[str, Column], good: str, bad: str, checkpoint: str, origin: str, row: str) -> None:
    """Accepted rows to one table, rejected ones with their reason to another, a batch at a time. Batches overwrite their own partition, so a repeat adds nothing."""

    def both(batch: DataFrame, number: int) -> None:
        marked = checked(batch, checks).withColumn("batch_no", F.lit(number))
        options = {"partitionOverwriteMode": "dynamic"}
        accepted(marked).write.mode("overwrite").options(**options).partitionBy("batch_no").parquet(good)
        dead_letters(marked, origin, row).withColumn("batch_no", F.lit(number)).write.mode("overwrite").options(**options).partitionBy("batch_no").parquet(bad)

    df.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def unfinished(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose last line in the progress log (file_name, timestamp, status) is not ``completed``."""
    last = log.groupBy("file_name").agg(F.max_by("status", "timestamp").alias("last"))
    return files.join(last.where("last = 'completed'"), "file_name", "left_anti")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of events in windows, for streams and tables alike; later events than the watermark are dropped in a stream."""
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    agg = grouped.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n_events", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    agg = grouped.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n_events"))
    return agg.select(F.col("window.start").alias("window_start"), "n_events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    agg = grouped.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return agg.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")
