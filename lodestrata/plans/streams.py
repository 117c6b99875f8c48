"""Streaming queries: a file stream over events, run to its end, and the event-time extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.registry import query
from lodestrata.plans.texts import BATCHES_SQL
from lodestrata.session import shared_folder, table
from lodestrata.streaming import incremental, memory


@query("stream_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inc_resume, inc_realtime_append: events are taken by a file stream to its end, then summed by hour; a second run would take nothing."""
    home = shared_folder(spark, "streams")
    source = f"{home}/in"
    events = table(spark, sf_dir, "events")
    events.write.parquet(f"{source}/day=1")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    incremental.run_available(incremental.new_files(spark, source, f"{ddl}, day int", "parquet"), f"{home}/out", f"{home}/state")
    taken = spark.read.parquet(f"{home}/out")
    return incremental.tumbling(taken).select("window_start", "event_type", "n_events", F.round("total", 4).alias("total"))


@query(
    "sliding_events",
    "SELECT window_start, count(*) AS n_events FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events) GROUP BY window_start",
)
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sliding windows."""
    return incremental.sliding(table(spark, sf_dir, "events"))


@query(
    "session_events",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM s GROUP BY user_id, no""",
)
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: session windows."""
    return incremental.sessions(table(spark, sf_dir, "events"))


@query("unfinished_files", "SELECT event_type AS file_name FROM events GROUP BY event_type HAVING max_by(user_id % 2, ts) <> 0")
def unfinished_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inc_resume: kinds of events stand for files, even users for completed lines."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_type").alias("file_name"), F.col("ts").alias("timestamp"), F.when(F.col("user_id") % 2 == 0, "completed").otherwise("running").alias("status"))
    return incremental.unfinished(log.select("file_name").distinct(), log)


@query("streamed_batches", BATCHES_SQL)
def streamed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_memory as a stream: messages arrive in three files by turn, and the batches handed on are those of the whole table."""
    home = shared_folder(spark, "memory")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    for step, which in enumerate(("turn < 3", "turn >= 3 AND turn < 15", "turn >= 15")):
        rows.where(which).coalesce(1).write.parquet(f"{home}/in/step={step}")
        arriving = incremental.new_files(spark, f"{home}/in", "conv_id bigint, turn bigint, role string, text string, step int", "parquet")
        memory.run_batches(arriving.drop("step"), f"{home}/out", f"{home}/state")
    return memory.last_versions(spark.read.schema(memory.COLUMNS).parquet(f"{home}/out"))
