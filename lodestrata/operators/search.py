"""Exact nearest neighbours by cosine, and statistics of embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.functions.vectors import cosine
from lodestrata.operators.lookup import small

#: Queries and vectors of a block.
BROADCAST_QUERIES, BLOCK_ROWS = 2000, 50_000
#: Scores that are held at once, and pairs that are compared at once; what rounding may add to a product, at most.
CELLS, PAIRS, SLACK = 4_000_000, 200_000, 1e-9


def top_k(vectors: DataFrame, query: list[float], k: int = 5, floor: float = 0.0) -> DataFrame:
    """The ``k`` rows of the greatest similarity, at least ``floor``; ties go to the smaller id. Vectors of length zero are left out.

    Only ids and similarities are sorted; join other columns afterwards.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("id", cosine(F.col("embedding"), q).alias("similarity")).where(F.col("similarity") >= floor)
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two arrays, summed from the first component on, as functions.vectors.dot() does."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * y[:, i]
    return total


def _nearest(key: tuple, asked: pa.Table, rows: pa.Table, k: int, floor: float, kinds: pa.Schema) -> pa.Table:
    """The best ``k`` rows of a block for each query of a block.

    A product of matrices tells which rows may be among them; those, with all that come within SLACK, are compared as cosine() does it.
    """
    size = key[0].as_py()
    if not len(asked) or not len(rows):
        return kinds.empty_table()
    rows = rows.take(pc.sort_indices(rows["id"], null_placement="at_start"))
    x, q = (np.asarray(t[c].combine_chunks().flatten()).astype(np.float64).reshape(-1, size) for t, c in ((rows, "embedding"), (asked, "query_embedding")))
    picked, scores = ([], []), []
    with np.errstate(all="ignore"):
        nx, nq = np.sqrt(_folded(x, x)), np.sqrt(_folded(q, q))
        odd, zero, ux, uq = ~np.isfinite(nx), np.flatnonzero(nx == 0), x / nx[:, None], q / nq[:, None]
        ux[odd | (nx == 0)] = 0
        step = max(1, min(256, CELLS // len(x)))
        for start in range(0, len(q), step):
            some = np.arange(start, min(start + step, len(q)))
            near = uq[some] @ ux.T
            near[:, zero] = -np.inf
            least = np.partition(near, -k, axis=1)[:, -k] if k < len(x) else np.full(len(some), -np.inf)
            maybe = near >= np.maximum(least, floor)[:, None] - SLACK
            maybe |= odd | ~np.isfinite(nq[some])[:, None]
            at, row = np.nonzero(maybe)
            for first, last in _stretches(at, PAIRS):
                no, to = some[at[first:last]], row[first:last]
                exact = np.concatenate([_folded(x[to[i : i + PAIRS]], q[no[i : i + PAIRS]]) / (nx[to[i : i + PAIRS]] * nq[no[i : i + PAIRS]]) for i in range(0, last - first, PAIRS)])
                fine = ((exact >= floor) | np.isnan(exact)) & (nx[to] * nq[no] != 0)
                no, to, exact = no[fine], to[fine], exact[fine]
                order = np.lexsort((to, -np.where(np.isnan(exact), np.inf, exact), ~np.isnan(exact), no))
                no, to, exact = no[order], to[order], exact[order]
                turn = np.arange(len(no)) - np.searchsorted(no, no)
                for out, part in zip((*picked, scores), (no, to, exact), strict=True):
                    out.append(part[turn < k])
    joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    no, to = (joined(p, np.int64) for p in picked)
    held = {c: asked[c].take(no) for c in asked.column_names} | {"id": rows["id"].take(to), "similarity": pa.chunked_array([pa.array(joined(scores, np.float64))])}
    return pa.table([held[f.name].cast(f.type) for f in kinds], schema=kinds)


def _stretches(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Places that cut the sorted ``at`` between its values into parts of about ``most``."""
    start = 0
    while start < len(at):
        end = int(np.searchsorted(at, at[min(start + most, len(at)) - 1], "right"))
        yield start, end
        start = end


def _comparable(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Rows whose vector can have a cosine, with its ``_size``."""
    held = rows.withColumn("_size", F.size(column)).where((F.col("_size") > 0) & F.forall(column, lambda x: x.isNotNull()))
    return held.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True)))


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """The ``k`` nearest rows of each query, numbered by ``rank``: the exact way, which compares all vectors with all queries.

    ``queries`` has query_id and query_embedding. Both are dealt to blocks, and each pair of blocks is a key of its own,
    whose task hands on only the best ``k`` rows of each query. ``by`` adds columns that both tables have, such as the
    model's name, which must agree; only vectors of one length are compared. ``ivf`` is the way by an index.
    """
    by = by or []
    rows = _comparable(vectors.select("id", "embedding", *by), "embedding", by)
    # New names of columns keep both sides apart where one table is made from the other.
    asked = _comparable(queries.select("query_id", "query_embedding", *[F.col(c).alias(c) for c in by]), "query_embedding", by)
    same = ["_size", *by]
    count = lambda t, most, out: t.groupBy(*same).agg(F.ceil(F.count(F.lit(1)) / most).alias(out))
    blocks = small(count(rows, BLOCK_ROWS, "_rows").join(count(asked, BROADCAST_QUERIES, "_asked"), same))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(blocks, same).withColumn("_i", F.pmod(F.xxhash64("query_id"), "_asked")).withColumn("_j", every("_rows")).drop("_rows", "_asked")
    right = rows.join(blocks, same).withColumn("_j", F.pmod(F.xxhash64("id"), "_rows")).withColumn("_i", every("_asked")).drop("_rows", "_asked")
    keys, cell = ["query_id", *by], [*same, "_i", "_j"]
    types = [(f.name, f.dataType) for f in (*(asked.schema[c] for c in keys), rows.schema["id"])]
    kinds = pa.schema([*((n, to_arrow_type(t)) for n, t in types), ("similarity", pa.float64())])
    named = ", ".join(f"{n} {t.simpleString()}" for n, t in types) + ", similarity double"
    scored = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(partial(_nearest, k=k, floor=floor, kinds=kinds), named)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def of_model(vectors: DataFrame, model: str, known: list[str]) -> DataFrame:
    """The rows of a model; an unknown one raises."""
    if model not in known:
        raise ValueError(f"unknown model: {model}")
    return vectors.where(F.col("model_name") == model)


def model_pairs(means: DataFrame) -> DataFrame:
    """Similarity of each pair of models (model_name, embedding) in order of name; null where lengths differ."""
    a = means.select(F.col("model_name").alias("model_a"), F.col("embedding").alias("_a"))
    b = means.select(F.col("model_name").alias("model_b"), F.col("embedding").alias("_b"))
    return a.join(F.broadcast(b), F.col("model_a") < F.col("model_b")).select("model_a", "model_b", cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def component_stats(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population standard deviation, least and greatest component of all vectors of a group."""
    each = vectors.select(*by, F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high")
    )


def mean_vectors(vectors: DataFrame, by: str) -> DataFrame:
    """The mean vector of each group."""
    each = vectors.select(by, F.posexplode("embedding").alias("pos", "v"))
    means = each.groupBy(by, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("embedding"))


def ingested(docs: DataFrame, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, chunks and embeddings of documents (source, content, embedding), keyed by a hash of source and content."""
    keyed = docs.withColumn("source_id", F.xxhash64("source", "content"))
    words = F.size(F.filter(F.split("content", r"(?U)\s+"), lambda w: w != ""))
    sources = keyed.select("source_id", "source").distinct()
    chunks = keyed.select(F.col("source_id").alias("chunk_id"), "source_id", F.lit(0).alias("chunk_index"), "content", words.alias("token_count")).dropDuplicates(["chunk_id"])
    embeddings = keyed.where(F.size("embedding") > 0).select(F.lit(model).alias("model_name"), F.col("source_id").alias("chunk_id"), "embedding").dropDuplicates(["chunk_id"])
    return sources, chunks, embeddings


def logged(results: DataFrame, places: int = 4) -> DataFrame:
    """One row a query: ids and similarities in order of rank (not-a-number becomes 0), their mean over finite ones, and how many."""
    s = F.col("similarity")
    finite = ~F.isnan(s) & (F.abs(s) != float("inf"))
    grouped = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("id"), F.when(finite, s).otherwise(0.0).alias("similarity")))).alias("found"),
        F.round(F.avg(F.when(finite, s)), places).alias("avg_similarity"), F.count(F.lit(1)).alias("top_k"),
    )
    return grouped.select("query_id", "top_k", "avg_similarity", F.transform("found", lambda x: x["id"]).alias("chunk_ids"), F.transform("found", lambda x: x["similarity"]).alias("similarities"))
