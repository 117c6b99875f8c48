"""Hard negatives by a k-nearest-neighbour join over Voronoi partitions.

A vector x of integers gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, and an
anchor gets 0 there: then the nearer of two rows is the one of the greater inner product.
Pivots, fitted on a bounded sample, divide the space into Voronoi cells. The anchors of a cell
form a group, and a few bounds a cell tell which rows it can need, by the triangle inequality:

* positives: the distance within which six rows of the label must lie (one may be the anchor
  itself), from the rows nearest to each pivot, plus the radius of the group's anchors;
* negatives: the ring of distances at which the scores allowed by its anchors' positives lie.

A row goes to those groups alone. A group's anchors are dealt to blocks, its rows too, and
each pair of blocks is joined exactly in a task of its own; windows merge their best ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, small_batches
from lodestrata.llm.multi_index import codebook, squared

#: Positives of an anchor and negatives of each of them.
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's, from and to.
LOW, HIGH = 30, 90
ANCHORS = 100
#: Vectors the pivots are fitted on, at most; anchors a pivot, and pivots at most.
SAMPLE, EACH, PIVOTS = 10_000, 128, 256
#: Anchors and rows of a block.
GROUP, BLOCK = 2048, 4096
#: Anchors whose scores with a block are held at once.
ROWS = 64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (moved on by one where vec_id is divisible by 7) and embedding of the rows that take part."""
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * 256 < float("inf")))
    rows = vectors.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(whole).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long"))


def _encode(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """floor(256 x) as bytes: whole numbers of the column's own kind of float, which holds them exactly."""
    for batch in batches:
        lists = batch["embedding"]
        flat = np.floor(np.asarray(lists.flatten()).astype(np.float64) * 256) + 0.0
        sizes = lists.value_lengths()
        ends, width = np.cumsum(np.asarray(sizes)).tolist(), np.dtype(kind).itemsize
        data = flat.astype(kind).tobytes()
        held = pa.array([data[width * i : width * j] for i, j in zip([0, *ends], ends, strict=False)], pa.binary())
        norms = pa.array([float(flat[i:j] @ flat[i:j]) for i, j in zip([0, *ends], ends, strict=False)], pa.float64())
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], sizes.cast(pa.int32()), norms, held], ["vec_id", "label", "size", "norm", "v"])


def matrix(column: pa.Array, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).astype(np.float64).reshape(len(column), size)


def augmented(x: np.ndarray, greatest: float | None) -> np.ndarray:
    """Rows with their last component; anchors, for which ``greatest`` is None, with 0."""
    last = np.zeros(len(x)) if greatest is None else np.sqrt(np.maximum(greatest - (x * x).sum(1), 0))
    return np.hstack([x, last[:, None]])


def _assign(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, size: int, kind: str, greatest: float | None) -> Iterator[pa.RecordBatch]:
    """Adds the cell of each row and the distance to its pivot."""
    for batch in batches:
        d = np.sqrt(squared(augmented(matrix(batch["v"], size, kind), greatest), pivots))
        cell = d.argmin(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "near"])


def _serve(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, size: int, kind: str, greatest: float, ring: dict[int, tuple[float, float]] | None) -> Iterator[pa.RecordBatch]:
    """A copy of each row for each group that might need it: those of its ``routes``, or with ``ring`` all groups whose ring it lies in."""
    for batch in batches:
        d = np.sqrt(squared(augmented(matrix(batch["v"], size, kind), greatest), pivots))
        if ring is None:
            routes = [[(r["group_cell"], 0.0, r["reach"]) for r in row] for row in batch["routes"].to_pylist()]
        else:
            routes = [[(c, *b) for c, b in ring.items()]] * len(batch)
        # Whatever cannot be told apart, as by an overflow, is served.
        found = [(i, c) for i, row in enumerate(routes) for c, low, high in row if not (d[i, c] > high or d[i, c] < low)]
        take = pa.array([i for i, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([c for _, c in found], pa.int32()), *[batch[n].take(take) for n in ("vec_id", "label", "v")]], ["cell", "vec_id", "label", "v"])


def _bounds(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds, to each group's label with a row near some pivot, the greatest distance of any of its anchors to that row."""
    gaps = np.sqrt(squared(pivots, pivots))
    for batch in batches:
        far = np.asarray(batch["radius"]) + gaps[np.asarray(batch["group_cell"]), np.asarray(batch["cell"])] + np.asarray(batch["near"])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far)], [*batch.schema.names, "far"])


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles; beyond a long they are its ends."""
    most = (np.abs(a).max(initial=0) * np.abs(c).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a @ c.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ c.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(c).T), 1 - 2**63, 2**63 - 1).astype(np.int64)


def _sides(anchors: pa.Table, rows: pa.Table, size: int, kind: str):
    """The rows of a block by ascending id, and the anchors' scores with them, a few anchors at a time."""
    ids = np.asarray(rows["vec_id"])
    order = np.argsort(ids, kind="stable")
    ids, labels = ids[order], np.asarray(rows["label"])[order]
    x, a = matrix(rows["v"].combine_chunks(), size, kind)[order], matrix(anchors["v"].combine_chunks(), size, kind)
    for start in range(0, len(a), ROWS):
        for i, scores in enumerate(products(a[start : start + ROWS], x), start):
            yield i, ids, labels, scores


def _positives(key: tuple, anchors: pa.Table, rows: pa.Table, size: int, kind: str, most: int) -> pa.Table:
    out, none = [], not len(anchors) or not len(rows)
    at = [anchors[c].to_pylist() for c in ("no", "vec_id", "label")]
    for i, ids, labels, scores in () if none else _sides(anchors, rows, size, kind):
        no, own, label = (c[i] for c in at)
        some = np.flatnonzero((labels == label) & (ids != own))
        best = some[np.argsort(-scores[some], kind="stable")[:most]]
        out += [(no, own, p, s) for p, s in zip(ids[best].tolist(), scores[best].tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["no", "anchor_id", "positive_id", "positive_score"])


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score a negative may have."""
    return -(-low * positive // 100), high * positive // 100


def _negatives(key: tuple, anchors: pa.Table, rows: pa.Table, size: int, kind: str, most: int, low: int, high: int) -> pa.Table:
    out, none = [], not len(anchors) or not len(rows)
    at = [anchors[c].to_pylist() for c in ("no", "label", "positives")]
    for i, ids, labels, scores in () if none else _sides(anchors, rows, size, kind):
        no, label, positives = (c[i] for c in at)
        some = np.flatnonzero(labels != label)
        some = some[np.argsort(-scores[some], kind="stable")]
        falling = -scores[some]
        for p in positives:
            least, greatest = window(p["positive_score"], low, high)
            start, end = np.searchsorted(falling, -greatest, "left"), np.searchsorted(falling, -least, "right")
            best = some[start : min(end, start + most)]
            out += [(no, p["place"], n, s) for n, s in zip(ids[best].tolist(), scores[best].tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["no", "place", "negative_id", "negative_score"])


def _joined(anchors: DataFrame, served: DataFrame, function: partial, schema: str) -> DataFrame:
    """``function`` of each block of a group's anchors with each block of the rows it is served.

    Both sides have the column cell. Served rows are dealt by the order of writing, whatever repeats in them.
    """
    served = materialise(served.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "served")
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sizes = served.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_rows"))
    groups = anchors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("n_anchors"))
    both = materialise(sizes.join(groups, "cell"), "groups")  # a row a pivot
    left = anchors.join(F.broadcast(both), "cell").withColumn("i", F.pmod(F.xxhash64("no"), "n_anchors")).withColumn("j", many("n_rows"))
    right = served.join(F.broadcast(both), "cell").withColumn("j", F.pmod("deal", "n_rows")).withColumn("i", many("n_anchors"))
    key = ["cell", "i", "j"]
    return left.drop("n_rows", "n_anchors").groupBy(*key).cogroup(right.drop("n_rows", "n_anchors", "deal").groupBy(*key)).applyInArrow(function, schema)


def _nearest_routes(anchors: DataFrame, rows: DataFrame, pivots: np.ndarray, most: int, slack: float) -> DataFrame:
    """label and ``routes``: the groups with anchors of the label, and the distance from their pivot up to which rows can be among an anchor's ``most`` best."""
    each = rows.groupBy("cell", "label", "vec_id").agg(F.min("near").alias("near"))  # an anchor can stand in its own way once
    rank = F.row_number().over(Window.partitionBy("cell", "label").orderBy("near", "vec_id"))
    nearest = each.withColumn("rank", rank).where(F.col("rank") <= most + 1).drop("rank")
    groups = anchors.groupBy(F.col("cell").alias("group_cell"), "label").agg(F.max("near").alias("radius"))
    met = groups.join(nearest, "label").select("label", "group_cell", "radius", "cell", "vec_id", "near")
    far = met.mapInArrow(partial(_bounds, pivots=pivots), "label long, group_cell int, radius double, cell int, vec_id long, near double, far double")
    far = far.groupBy("label", "group_cell", "vec_id").agg(F.max("radius").alias("radius"), F.min("far").alias("far"))
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("label", "group_cell").orderBy("far", "vec_id"))).where(F.col("rank") <= most + 1)
    theta = ranked.groupBy("label", "group_cell").agg(F.max("radius").alias("radius"), F.max("far").alias("far"), F.max("rank").alias("found"))
    reach = F.when(F.col("found") > most, (F.col("far") + F.col("radius")) * (1 + 1e-9) + slack).otherwise(float("inf"))
    return theta.groupBy("label").agg(F.collect_list(F.struct("group_cell", reach.alias("reach"))).alias("routes"))  # a pivot each at most


def _mine(rows: DataFrame, size: int, n: int, greatest: float, kind: str, every: int, positives: int, negatives: int, low: int, high: int, sample: int) -> DataFrame:
    """Hard negatives among the vectors of one length."""
    some = rows.orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("v").toArrow()
    x = augmented(matrix(some["v"].combine_chunks(), size, kind), greatest)
    pivots = codebook(x, max(4, min(PIVOTS, n // every // EACH)), np.random.default_rng(7))
    slack, kept = 1e-6 * greatest**0.5 + 1e-6, "vec_id long, label long, size int, norm double, v binary"
    place = {"pivots": pivots, "size": size, "kind": kind}
    of_anchors = rows.where(F.col("vec_id") % every == 0).distinct().mapInArrow(partial(_assign, **place, greatest=None), f"{kept}, cell int, near double")
    anchors = materialise(of_anchors.withColumn("no", F.monotonically_increasing_id()), "anchors")
    placed = materialise(rows.mapInArrow(partial(_assign, **place, greatest=greatest), f"{kept}, cell int, near double"), "cells")

    routes = _nearest_routes(anchors, placed, pivots, positives, slack)
    routed = placed.select("label", "vec_id", "v").join(routes, "label")
    served = routed.mapInArrow(partial(_serve, **place, greatest=greatest, ring=None), "cell int, vec_id long, label long, v binary")
    best = _joined(anchors.select("cell", "no", "vec_id", "label", "v"), served, partial(_positives, size=size, kind=kind, most=positives), "no long, anchor_id long, positive_id long, positive_score long")
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("no").orderBy(F.desc("positive_score"), "positive_id")).cast("long")).where(F.col("place") <= positives)
    pairs = materialise(ranked, "positives")

    # A positive of negative score allows no score at all.
    allowed = pairs.where("positive_score >= 0").groupBy("no").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("positives"),
        F.min("positive_score").alias("worst"), F.max("positive_score").alias("best"),
    )
    asking = materialise(anchors.join(allowed, "no"), "asking")
    # Squared distance at a score s: |q|^2 + M^2 - 2 s.
    at = lambda score: F.sqrt(F.greatest(F.col("norm") + greatest - score.cast("double") * 2, F.lit(0.0)))
    least, most = F.floor(F.col("worst") * (low / 100) - 1), F.ceil(F.col("best") * (high / 100) + 1)
    rings = asking.groupBy("cell").agg(F.min((at(most) - F.col("near")) * (1 - 1e-9)).alias("low"), F.max((at(least) + F.col("near")) * (1 + 1e-9)).alias("high"))
    ring = {r["cell"]: (r["low"] - slack, r["high"] + slack) for r in rings.collect()}  # a row a pivot
    served = placed.select("label", "vec_id", "v").mapInArrow(partial(_serve, **place, greatest=greatest, ring=ring), "cell int, vec_id long, label long, v binary")
    mine = partial(_negatives, size=size, kind=kind, most=negatives, low=low, high=high)
    found = _joined(asking.select("cell", "no", "label", "v", "positives"), served, mine, "no long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("no", "place").orderBy(F.desc("negative_score"), "negative_id"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return top.join(pairs, ["no", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def hard_negatives(
    vectors: DataFrame, every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, sample: int = SAMPLE
) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vec_id`` and ``label`` are whole numbers. Anchors are the rows whose vec_id is divisible by ``every``. Scores are
    inner products of floor(256 x), exact; beyond the range of a long they are its ends. Ties go to the smaller vec_id.
    Rows of a null vec_id, label, vector or component, or of a component that is not finite, take no part;
    vectors of different lengths never meet, and empty ones score 0. Rows that share a vec_id are never partners of each other;
    apart from that each row counts, so repeated rows are found repeatedly, but an anchor repeated whole asks once.
    Columns beyond vec_id, label and embedding are ignored, whatever their names. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    plain = usable(vectors).withColumn("vec_id", F.col("vec_id").cast("long"))
    rows = materialise(plain.mapInArrow(partial(_encode, kind=kind), "vec_id long, label long, size int, norm double, v binary"), "scaled")
    lengths = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("greatest"), F.count_if(F.col("vec_id") % every == 0).alias("asking")).where("asking > 0").orderBy("size").collect()
    found = None
    for size, n, greatest, _ in lengths:  # a handful of lengths
        part = _mine(rows.where(F.col("size") == size), size, n, greatest, kind, every, positives, negatives, low, high, sample)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found


def digest(vectors: DataFrame) -> DataFrame:
    """The op13 columns of embeddings."""
    return hard_negatives(vectors)
