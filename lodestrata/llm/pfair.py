"""Mixing sources to target weights by Pfair scheduling. Spark SQL expressions only.

A source of weight w out of W gets one block of rows in every window: its k-th block may
not start before floor((k - 1) * W / w) and must be placed before ceil(k * W / w). Taking
at every slot the released block with the earliest deadline keeps each source within less
than one block of its share at every prefix. The windows repeat after W slots, so one
period is scheduled (a fold over W slots) and every block's slot follows by arithmetic.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OTHER = "(other)"
#: Production weights: the large source is held down, all others count alike.
WEIGHTS = {"src0": 4} | {f"src{i}": 1 for i in range(1, 20)}
BLOCK_ROWS = 8
#: Hex digits by which a group is split: at most 16**SPLIT parts of it.
SPLIT = 3


def period(spark: SparkSession, weights: Mapping[str, int]) -> DataFrame:
    """One period: source, weight, total, k (from 0), release, deadline, slot. It has sum(weights) rows."""
    names = list(weights)
    if not names or min(weights.values()) < 1:
        raise ValueError("weights must be positive whole numbers")
    total = sum(weights.values())
    table = spark.createDataFrame([(i, n, weights[n]) for i, n in enumerate(names)], "source_no int, source string, weight int")
    ws = f"array({', '.join(str(weights[n]) for n in names)})"
    choose = f"""aggregate(
        sequence(0, {total - 1}),
        named_struct('done', array_repeat(0, {len(names)}), 'picked', cast(array() as array<int>)),
        (acc, t) -> named_struct(
            'done', transform(acc.done, (d, i) -> d + if(i = {{pick}}, 1, 0)),
            'picked', array_append(acc.picked, {{pick}})),
        acc -> acc.picked)""".replace(
        "{pick}",
        f"""array_min(filter(transform(acc.done, (d, i) -> if(d < {ws}[i] and floor(d * {total} / {ws}[i]) <= t,
            named_struct('deadline', ceil((d + 1) * {total} / {ws}[i]), 'i', i), null)), x -> x is not null)).i""".replace("{ws}", ws),
    )
    picked = spark.range(1).select(F.posexplode(F.expr(choose)).alias("slot", "source_no"))
    k = F.row_number().over(Window.partitionBy("source_no").orderBy("slot")) - 1
    out = picked.withColumn("k", k).join(table, "source_no").withColumn("total", F.lit(total))
    share = F.col("total") / F.col("weight")
    return out.select(
        "source", "weight", "total", "k", F.floor(F.col("k") * share).alias("release"),
        F.ceil((F.col("k") + 1) * share).alias("deadline"), F.col("slot").cast("long").alias("slot"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``no`` to rows of mix_group, key and held: the number, from 0, of each row in its group, in the order of the MD5 of ``key``, then ``key`` (null first), then ``tie``.

    Groups are split by the first SPLIT hex digits: rows are numbered within (group, part),
    after the counts of the parts before. So no group, however large, meets in one task, and
    the numbers depend on the rows alone.
    """
    split = rows.withColumn("md5", F.coalesce(F.md5(F.col("key").cast("string").cast("binary")), F.lit(""))).withColumn("part", F.substring("md5", 1, SPLIT))
    counts = split.groupBy("mix_group", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("mix_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("mix_group", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("mix_group", "part").orderBy("md5", "key", "tie")) - 1
    return split.withColumn("inside", inside).join(starts, ["mix_group", "part"]).select("mix_group", "held", (F.col("inside") + F.col("before")).alias("no"))


OUT = ("mix_group", "block_no", "release", "deadline", "slot", "place")


def mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, block_rows: int = BLOCK_ROWS, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Add mix_group, block_no, release, deadline, slot and place; ordering by (slot, place) gives the mix.

    Sources without a weight, null ones included, share the group ``(other)`` of weight 1. A
    block is ``block_rows`` rows of a group in the order of the MD5 of ``key`` and then
    ``key`` (null first). All rows stay: where a group has run out, its slots are empty and
    the others go on. Up to the first such slot each group is within less than one block of
    its share of any prefix. Ties of ``key`` are told apart by the SHA-256 of the whole row,
    so that only equal rows change places in a rerun. Columns named like an added one are
    replaced, all others pass through whatever their names. An empty table gives no rows.
    """
    known = {**weights} if OTHER in weights else {**weights, OTHER: 1}
    plan = F.broadcast(period(docs.sparkSession, known))  # sum(weights) rows, a parameter
    group = F.when(F.col(source).isin(*known), F.col(source)).otherwise(F.lit(OTHER))
    kept = [c for c in docs.columns if c not in OUT]
    # The columns travel as one, so that no name of theirs meets one of the work.
    rows = docs.select(group.alias("mix_group"), F.col(key).alias("key"), F.sha2(F.to_json(F.struct(*docs.columns)), 256).alias("tie"), F.struct(*kept).alias("held"))
    size = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    blocks = numbered(rows).withColumn("block_no", F.floor(F.col("no") / block_rows)).withColumn("turn", F.col("block_no") % size[F.col("mix_group")])
    plan = plan.select(F.col("source").alias("mix_group"), F.col("k").cast("long").alias("turn"), "weight", "total", "release", "deadline", "slot")
    base = F.floor(F.col("block_no") / F.col("weight")) * F.col("total")
    return blocks.join(plan, ["mix_group", "turn"]).select(
        *[F.col("held")[c].alias(c) for c in kept], "mix_group", "block_no",
        *[(base + F.col(c)).alias(c) for c in ("release", "deadline", "slot")], (F.col("no") % block_rows).cast("int").alias("place"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The op8 rows: each document's block, its window and its slot."""
    return mix(docs.select("doc_id", "source")).select("doc_id", "source", "mix_group", "block_no", "release", "deadline", "slot", "place")
