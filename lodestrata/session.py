"""Session construction and table access."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

#: Bytes handed to Python at once, if no single row is larger.
BATCH_BYTES = 16 << 20


def session(cores: int | str = "*", partitions: int = 8, app: str = "lodestrata", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, ANSI on).

    On a cluster build the session with the cluster's own settings instead; no
    operator needs more than ``spark.sql.session.timeZone=UTC``.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset a temporary one in local runs, and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='lodestrata-')).rstrip('/')}/{label}-{uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python ``rows`` at a time, so that workers stay small; larger settings of the session are lowered."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"\d+(?=b?$)", spark.conf.get(name))
        if not (now and 0 < int(now[0]) <= most):
            spark.conf.set(name, str(most))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every table as a temporary view, for SQL text."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
