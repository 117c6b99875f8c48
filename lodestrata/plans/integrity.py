"""Keys, references and checks, and the SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.operators import sqlfunctions
from lodestrata.plans.registry import query
from lodestrata.session import table


@query("orphan_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a RESTRICT rule would name."""
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return schemas.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", parents, "o_orderkey")


@query("references_cleared", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN o_custkey END AS o_custkey FROM orders")
def references_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET NULL."""
    return schemas.enforced(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey", "set_null")


@query("references_cascaded", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NULL OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def references_cascaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CASCADE."""
    return schemas.enforced(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey", "cascade")


@query("repeated_keys", "SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNIQUE."""
    return schemas.repeated(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("sql_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) b")
def sql_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar SQL function."""
    e = table(spark, sf_dir, "embeddings")
    e.select(F.col("label").cast("string").alias("model_name"), F.col("vec_id").alias("chunk_id"), "embedding").createOrReplaceTempView("chunk_embeddings")
    sqlfunctions.register(spark)
    one = F.broadcast(e.where("vec_id = 3").select(F.col("embedding").alias("q")))  # one row
    return e.select("vec_id", "embedding").crossJoin(one).select("vec_id", F.expr("round(cosine_similarity(embedding, q), 6)").alias("similarity"))


@query(
    "sql_search",
    """SELECT a.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) b WHERE a.label = 2
ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, a.vec_id LIMIT 5""",
)
def sql_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL table function, over one model's vectors."""
    e = table(spark, sf_dir, "embeddings")
    e.select(F.col("label").cast("string").alias("model_name"), F.col("vec_id").alias("chunk_id"), "embedding").createOrReplaceTempView("chunk_embeddings")
    sqlfunctions.register(spark)
    q = ", ".join(f"CAST({x!r} AS FLOAT)" for x in e.where("vec_id = 3").first()["embedding"])
    return spark.sql(f"SELECT chunk_id, round(similarity, 6) AS similarity FROM search_similar_chunks(array({q}), '2', 5, CAST(-1 AS DOUBLE))")
