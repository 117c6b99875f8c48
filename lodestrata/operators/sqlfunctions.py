"""The procedural surface as temporary SQL functions: ``cosine_similarity`` and ``search_similar_chunks``."""

from __future__ import annotations

from pyspark.sql import SparkSession

COSINE = """CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE
RETURN CASE WHEN size(a) = size(b) THEN try_divide(aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x),
  sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))) END"""

SEARCH = """CREATE OR REPLACE TEMPORARY FUNCTION search_similar_chunks(query ARRAY<FLOAT>, model STRING, k INT, floor DOUBLE)
RETURNS TABLE (chunk_id BIGINT, similarity DOUBLE)
RETURN SELECT chunk_id, similarity FROM (SELECT chunk_id, similarity, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS place
  FROM (SELECT chunk_id, cosine_similarity(embedding, query) AS similarity FROM {table} WHERE model_name = model) WHERE similarity >= floor) WHERE place <= k"""


def register(spark: SparkSession, table: str = "chunk_embeddings") -> None:
    """Define both functions over a table or view with model_name, chunk_id and embedding."""
    spark.sql(COSINE)
    spark.sql(SEARCH.format(table=table))
