"""Shared helpers: tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import small_batches as small_batches

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a temporary one in local runs, tests among them, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="lodestrata-"))
    return _OWN[0]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts lineage the way checkpoint() does, in a compressed columnar form, and lets
    several branches use one computation. Lost executors lose nothing of it. Like a
    checkpoint it stays, for results that are read later, until the folder is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` evaluated once, however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def spread(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def roots(links: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix the smallest index of each row's component."""
    at = np.arange(len(links))
    linked = links | np.eye(len(links), dtype=bool)
    while True:
        low = np.where(linked, at[None, :], len(at)).min(1)
        low = np.minimum(low, low[low])
        if (low == at).all():
            return low
        at = low


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph: columns ``id`` and ``component_id`` (the smallest id).

    Alternates the large-star and small-star steps: each round relinks every vertex to
    the smallest vertex known in its neighbourhood, by aggregates and joins only. Rounds
    grow with the logarithm of the number of vertices. Each round is written to the
    shared folder. Null ends and self-loops are ignored; vertices without an edge are absent.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    e = materialise(e, "edges")
    seen = _signature(e)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, "edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)


def _signature(e: DataFrame) -> tuple:
    row = e.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
