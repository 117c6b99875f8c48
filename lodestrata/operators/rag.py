"""Retrieval and augmentation put together; encoders and generators are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.money import token_estimate
from lodestrata.functions.text import keyword_tokens
from lodestrata.operators import augment, evaluate, rerank, search

Encoder = Callable[[Column], Column]
# Prefixes of the models that want one.
PREFIXES = {"e5": ("query: ", "passage: ")}
#: Candidates that are reranked for each result asked for.
POOL = 4


def prepared(text: Column, family: str, is_query: bool) -> Column:
    """A text as its model family wants it."""
    before = PREFIXES.get(family, ("", ""))[0 if is_query else 1]
    return F.concat(F.lit(before), text) if before else text


def hash_encoder(dimension: int = 64) -> Encoder:
    """A deterministic stand-in for a model: token counts hashed into ``dimension`` places; a blank text is the zero vector."""

    def encode(text: Column) -> Column:
        places = F.transform(keyword_tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)))
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))

    return encode


def encoded(rows: DataFrame, text: str, encoder: Encoder, out: str = "embedding", family: str = "", is_query: bool = False) -> DataFrame:
    return rows.withColumn(out, encoder(prepared(F.col(text), family, is_query)))


def searched(chunks: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.0, reranked: bool = False) -> DataFrame:
    """Results (query_id, id, rank, similarity, content, chunk_index, prior_rank, query) of queries (query_id, query, query_embedding).

    Only ids and similarities are ranked; contents are joined to the winners. With
    ``reranked`` four times as many candidates are reordered by their keywords.
    """
    pool = k * POOL if reranked else k
    top = search.top_k_each(chunks.select("id", "embedding"), queries.select("query_id", "query_embedding"), pool, floor)
    held = top.join(chunks.select("id", "content", "chunk_index"), "id").join(queries.select("query_id", "query"), "query_id").withColumn("prior_rank", F.col("rank"))
    return rerank.ranked(rerank.by_keywords(held.drop("rank")), k=k) if reranked else held


def augmented(results: DataFrame, queries: DataFrame, layout: str = "prompt", budget: int = augment.BUDGET) -> DataFrame:
    """query_id, context, n_chars and n_tokens of each query's context."""
    found = results if "source" in results.columns else results.withColumn("source", F.lit(None).cast("string"))
    context = augment.LAYOUTS[layout](augment.selected(found.drop("rank"), budget), queries.select("query_id", "query"))
    return context.select("query_id", "context", F.length("context").alias("n_chars"), token_estimate(F.col("context")).alias("n_tokens"))


def answered(contexts: DataFrame, generator: Encoder) -> DataFrame:
    """Contexts with the answer of a generator, given as a function of a column."""
    return contexts.withColumn("answer", generator(F.col("context")))


def evaluated(chunks: Mapping[str, DataFrame], queries: DataFrame, k: int = 5, reranked: bool = False) -> DataFrame:
    """Per model: its metrics over the queries (query_id, query, query_embedding, expected)."""
    out = None
    for model, rows in chunks.items():
        results = searched(rows, queries, k, reranked=reranked)
        one = evaluate.standard(results, queries).crossJoin(evaluate.similarity_stats(results, queries)).withColumn("model_name", F.lit(model))  # one row each
        out = one if out is None else out.unionByName(one)
    return out
