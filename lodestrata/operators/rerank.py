"""Rerankers: each adds its score and ``rerank_score`` to candidates (query_id, content, similarity, prior_rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import keyword_tokens, words
from lodestrata.functions.vectors import cosine_or_zero

# The weights of the rerankers and of their default combination.
KEYWORD_WEIGHT, LENGTH_WEIGHT, POSITION_WEIGHT, SEMANTIC_WEIGHT, OPTIMAL_LENGTH = 0.3, 0.1, 0.1, 0.4, 200
COMBINED_WEIGHTS = {"keyword_score": 0.6, "length_score": 0.2, "position_score": 0.2}


def overlap(query: Column, content: Column) -> Column:
    """Share of the query's distinct tokens that the content has; 0 for a query without tokens."""
    wanted = F.array_distinct(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, content)).cast("double"), F.size(wanted)), F.lit(0.0))


def mixed(similarity: Column, score: Column, weight: float) -> Column:
    return similarity * (1 - weight) + score * weight


def length_score(content: Column, optimal: int = OPTIMAL_LENGTH) -> Column:
    """1 at the optimal length, less with the distance from it."""
    return 1.0 / (1.0 + F.abs(F.length(content) - optimal) / optimal)


def position_score(chunk_index: Column) -> Column:
    """1 for the first chunk of a document, less for later ones; an unknown place counts as the first."""
    return 1.0 / (1.0 + F.coalesce(chunk_index, F.lit(0)) * 0.1)


def _ready(c: DataFrame, name: str, suffix: str, made: Column) -> Column:
    """The tokens that the candidates bring along as ``<name>_<suffix>``, or else ``made``."""
    return F.col(f"{name}_{suffix}") if f"{name}_{suffix}" in c.columns else made


def by_keywords(c: DataFrame, query: str = "query", weight: float = KEYWORD_WEIGHT) -> DataFrame:
    wanted, held = (_ready(c, name, "tokens", keyword_tokens(F.col(name))) for name in (query, "content"))
    scored = c.withColumn("keyword_score", overlap(wanted, held))
    return scored.withColumn("rerank_score", mixed(F.col("similarity"), F.col("keyword_score"), weight))


def by_length(c: DataFrame, optimal: int = OPTIMAL_LENGTH, weight: float = LENGTH_WEIGHT) -> DataFrame:
    scored = c.withColumn("length_score", length_score(F.col("content"), optimal))
    return scored.withColumn("rerank_score", mixed(F.col("similarity"), F.col("length_score"), weight))


def by_position(c: DataFrame, weight: float = POSITION_WEIGHT) -> DataFrame:
    scored = c.withColumn("position_score", position_score(F.col("chunk_index")))
    return scored.withColumn("rerank_score", mixed(F.col("similarity"), F.col("position_score"), weight))


def by_meaning(c: DataFrame, weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """By the cosine of query_embedding and content_embedding; where one is missing the similarity stays."""
    there = F.col("query_embedding").isNotNull() & F.col("content_embedding").isNotNull()
    scored = c.withColumn("semantic_score", F.when(there, cosine_or_zero(F.col("query_embedding"), F.col("content_embedding"))).otherwise(F.col("similarity")))
    return scored.withColumn("rerank_score", F.when(there, mixed(F.col("similarity"), F.col("semantic_score"), weight)).otherwise(F.col("similarity")))


def combined(c: DataFrame, query: str = "query", fixed: bool = False) -> DataFrame:
    """All three cheap scores and ``final_rerank_score``.

    As observed, the final score is the similarity alone; ``fixed`` mixes in the weighted scores.
    """
    scored = by_position(by_length(by_keywords(c, query)))
    if not fixed:
        return scored.withColumn("final_rerank_score", F.col("similarity"))
    total = sum((F.col(k) * w for k, w in COMBINED_WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("final_rerank_score", (F.col("similarity") * 0.5 + total * 0.5) / (0.5 + sum(COMBINED_WEIGHTS.values()) * 0.5))


def simple(c: DataFrame, query: str = "query") -> DataFrame:
    """0.7 similarity, 0.2 shared words, 0.1 length (0.8 for texts below 50 characters, 0.9 above 1000)."""
    n = F.length("content")
    length = F.when(n < 50, 0.8).when(n > 1000, 0.9).otherwise(1.0)
    shared = overlap(*(_ready(c, name, "words", words(F.lower(F.col(name)))) for name in (query, "content")))
    return c.withColumn("rerank_score", F.col("similarity") * 0.7 + shared * 0.2 + length * 0.1)


def ranked(c: DataFrame, score: str = "rerank_score", k: int | None = None) -> DataFrame:
    """``rank`` by score; ties keep the order they came in."""
    out = c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "prior_rank")))
    return out if k is None else out.where(F.col("rank") <= k)
