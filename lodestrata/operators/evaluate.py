"""Retrieval metrics as aggregates.

``results``: query_id, rank (from 1), content, similarity. ``queries``: query_id and
expected, an array of keywords. A result is relevant if it holds an expected keyword,
whatever its case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import entity_density, keyword_tokens, keywords_in
from lodestrata.operators.rerank import overlap

CUTS = (1, 3, 5)
# Words of the domain.
DOMAIN = (
    "신혼부부", "임차보증금", "이자지원", "대출", "한도", "소득", "기준", "신청", "절차", "서류", "금리", "기간", "대상주택", "조건", "제외사항",
    "반환보증", "보증료", "연장", "중단", "예비신혼부부", "자격", "청년", "전세", "월세", "버팀목", "주거급여", "서울형", "바우처", "긴급", "복지",
)
CONTEXT = ("대출", "이자", "보증금", "임차", "주택", "금리", "신청", "자격", "소득", "한도", "서류", "절차", "지원", "서울시", "신혼부부")
SPECIFIC = (
    "임차보증금", "이자지원", "대출한도", "소득기준", "신혼부부", "전세", "월세", "보증서", "금융공사", "주택금융", "연소득", "무주택자", "세대주", "혼인관계", "가족관계", "주민등록",
)
# Weights of the parts of the overall score.
WEIGHTS = {"keyword_f1": 0.25, "semantic_coherence": 0.20, "context_relevance": 0.20, "entity_recognition": 0.15, "domain_specificity": 0.15, "avg_similarity": 0.05}


def harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(p * r * 2, p + r), F.lit(0.0))


def share_of(text: Column, words: tuple[str, ...]) -> Column:
    """Share of fixed words that a text holds."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words]) / float(len(words))


def per_query(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Precision, recall, F1 and hit at 1, 3 and 5, reciprocal rank, NDCG at 3 and 5 of each query with an expectation.

    A query without results has zeros. Precision counts distinct keywords against
    min(k, results) and may exceed 1, as may NDCG when fewer keywords than results are expected.
    """
    wanted = queries.where(F.size("expected") > 0).withColumn("expected", F.array_distinct("expected"))
    hits = results.join(wanted, "query_id").select("query_id", "rank", keywords_in(F.col("content"), F.col("expected")).alias("hits"))
    gain = F.when(F.size("hits") > 0, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    up_to = lambda k, c: F.when(F.col("rank") <= k, c)
    summed = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.size("hits") > 0, F.col("rank"))).alias("first_hit"),
        *[F.size(F.array_distinct(F.flatten(F.collect_list(up_to(k, F.col("hits")))))).alias(f"found_{k}") for k in CUTS],
        *[F.sum(up_to(k, gain)).alias(f"dcg_{k}") for k in (3, 5)],
    )
    joined = wanted.join(summed, "query_id", "left")
    n, m = F.coalesce("n", F.lit(0)), F.size("expected")
    cols = []
    for k in CUTS:
        found = F.coalesce(f"found_{k}", F.lit(0)).cast("double")
        p = F.coalesce(F.try_divide(found, F.least(n, F.lit(k))), F.lit(0.0))
        r = found / m
        cols += [p.alias(f"precision_{k}"), r.alias(f"recall_{k}"), harmonic(p, r).alias(f"f1_{k}"), F.when(found > 0, 1.0).otherwise(0.0).alias(f"hit_{k}")]
    for k in (3, 5):
        top = F.least(F.least(n, F.lit(k)), m)
        ideal = F.aggregate(F.when(top > 0, F.sequence(F.lit(1), top.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        cols.append(F.coalesce(F.try_divide(F.col(f"dcg_{k}"), ideal), F.lit(0.0)).alias(f"ndcg_{k}"))
    return joined.select("query_id", *cols, F.coalesce(F.try_divide(F.lit(1.0), F.col("first_hit")), F.lit(0.0)).alias("mrr"))


def standard(results: DataFrame, queries: DataFrame, places: int = 6) -> DataFrame:
    """One row: the means of ``per_query``."""
    each = per_query(results, queries)
    return each.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), places).alias(c) for c in each.columns if c != "query_id"])


def latency(runs: DataFrame, column: str, places: int = 6) -> DataFrame:
    """One row: mean, median, extremes, sample deviation (0 below two values) and linearly interpolated percentiles."""
    v = F.col(column)
    r = lambda c: F.round(c, places)
    p = F.percentile(v, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return runs.agg(
        r(F.avg(v)).alias("avg_ms"), r(F.median(v)).alias("median_ms"), r(F.min(v)).alias("min_ms"), r(F.max(v)).alias("max_ms"),
        r(F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("stddev_ms"), r(F.get(p, F.lit(0))).alias("p50_ms"), r(F.get(p, F.lit(1))).alias("p95_ms"), r(F.get(p, F.lit(2))).alias("p99_ms"),
    )


def similarity_stats(results: DataFrame, queries: DataFrame, places: int = 6) -> DataFrame:
    """One row: queries, those with a result, their share, results, and statistics of finite similarities."""
    s = F.col("similarity")
    fine = F.when(~F.isnan(s) & (F.abs(s) != float("inf")), s)
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), places)
    joined = queries.select("query_id").join(results.select("query_id", "similarity", F.lit(1).alias("one")), "query_id", "left")
    return joined.agg(
        F.countDistinct("query_id").alias("total_queries"), F.countDistinct(F.when(F.col("one") == 1, F.col("query_id"))).alias("successful_queries"),
        r(F.try_divide(F.countDistinct(F.when(F.col("one") == 1, F.col("query_id"))), F.countDistinct("query_id"))).alias("success_rate"), F.count("one").alias("total_results"),
        r(F.avg(fine)).alias("avg_similarity"), r(F.min(fine)).alias("min_similarity"), r(F.max(fine)).alias("max_similarity"), r(F.stddev_samp(fine)).alias("stddev_similarity"),
    )


def korean(results: DataFrame, queries: DataFrame, places: int = 6) -> DataFrame:
    """One row: keyword precision, recall and F1 over queries with results, domain specificity over results, coherence over queries."""
    wanted = queries.where(F.size("expected") > 0).withColumn("expected", F.array_distinct("expected"))
    hits = results.join(wanted, "query_id").select("query_id", F.size("expected").alias("m"), F.explode_outer(keywords_in(F.col("content"), F.col("expected"))).alias("k"))
    found = hits.groupBy("query_id", "m").agg(F.countDistinct("k").alias("n")).agg(F.coalesce(F.avg(F.col("n") / F.col("m")), F.lit(0.0)).alias("p"))
    spread = results.agg(F.coalesce(F.avg(share_of(F.col("content"), DOMAIN)), F.lit(0.0)).alias("domain"))
    held = results.groupBy("query_id").agg(F.avg("similarity").alias("s")).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("coherence"))
    row = found.crossJoin(spread).crossJoin(held)  # one row each
    r = lambda c: F.round(c, places)
    p = F.col("p")
    return row.select(r(p).alias("keyword_precision"), r(p).alias("keyword_recall"), r(harmonic(p, p)).alias("keyword_f1"), r(F.col("domain")).alias("domain_specificity"), r(F.col("coherence")).alias("semantic_coherence"))


def understanding(results: DataFrame, queries: DataFrame, places: int = 6) -> DataFrame:
    """The six parts of each query's score and the weighted sum, 1 at most; ``queries`` also has query."""
    joined = results.join(queries, "query_id")
    s = F.col("similarity")
    coherence = overlap(keyword_tokens(F.col("query")), keyword_tokens(F.col("content"))) * 0.6 + s * 0.4
    grouped = joined.groupBy("query_id").agg(
        F.avg(s).alias("avg_similarity"), F.avg(coherence).alias("semantic_coherence"), F.avg(share_of(F.col("content"), CONTEXT)).alias("context_relevance"),
        F.avg(entity_density(F.col("content"))).alias("entity_recognition"), F.avg(share_of(F.col("content"), SPECIFIC)).alias("domain_specificity"),
        F.size(F.array_distinct(F.flatten(F.collect_list(keywords_in(F.col("content"), F.col("expected")))))).alias("_found"), F.max(F.size("expected")).alias("_expected"),
    )
    f1 = F.coalesce(F.try_divide(F.col("_found").cast("double"), F.col("_expected")), F.lit(0.0))
    scored = grouped.withColumn("keyword_f1", f1)
    total = F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.col(k) * w for k, w in WEIGHTS.items()]))
    return scored.select("query_id", *[F.round(k, places).alias(k) for k in WEIGHTS], F.round(total, places).alias("overall_score"))


def compare_models(runs: DataFrame, places: int = 6) -> DataFrame:
    """Per model_name: mean time_ms, mean top-1 and mean top-3 similarity of its queries' ``similarities``."""
    top3 = F.slice("similarities", 1, 3)
    mean3 = F.try_divide(F.aggregate(top3, F.lit(0.0), lambda a, x: a + x), F.size(top3))
    return runs.groupBy("model_name").agg(
        F.round(F.avg("time_ms"), places).alias("avg_time_ms"), F.round(F.avg(F.coalesce(F.get("similarities", F.lit(0)), F.lit(0.0))), places).alias("avg_top1"),
        F.round(F.avg(F.coalesce(mean3, F.lit(0.0))), places).alias("avg_top3"),
    )


def rankings(metrics: DataFrame, higher: dict[str, bool]) -> DataFrame:
    """For each metric the models from the best; ``higher`` says whether more is better. Ties go by name."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), (F.col(m).cast("double") * (-1 if up else 1)).alias("_key")) for m, up in higher.items()])).alias("x")
    each = metrics.select("model_name", long).select("model_name", "x.*").where("value IS NOT NULL")
    found = each.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("_key", "model_name", "value"))).alias("_all"))
    return found.select("metric", F.transform("_all", lambda x: x["model_name"]).alias("models"))


def winners(metrics: DataFrame) -> DataFrame:
    """One row: the fastest, the most similar, and those of the best recall and reciprocal rank."""
    return metrics.agg(
        F.min_by("model_name", F.struct("avg_time_ms", "model_name")).alias("fastest"), F.min_by("model_name", F.struct(-F.col("avg_similarity"), "model_name")).alias("most_similar"),
        F.min_by("model_name", F.struct(-F.col("recall"), "model_name")).alias("best_recall"), F.min_by("model_name", F.struct(-F.col("mrr"), "model_name")).alias("best_mrr"),
    )


def rerank_effect(base: DataFrame, reranked: DataFrame, places: int = 6) -> DataFrame:
    """Per model: similarity lift in percent, added time, and changes of recall and NDCG. Both have model_name, avg_similarity, avg_time_ms, recall, ndcg."""
    names = ("avg_similarity", "avg_time_ms", "recall", "ndcg")
    new = reranked.select("model_name", *[F.col(c).alias(f"r_{c}") for c in names])
    r = lambda c, name: F.round(c, places).alias(name)
    change = lambda c: F.col(f"r_{c}") - F.col(c)
    lift = F.coalesce(F.try_divide(change("avg_similarity") * 100, F.col("avg_similarity")), F.lit(0.0))
    return base.join(new, "model_name").select("model_name", r(lift, "similarity_lift_percent"), r(change("avg_time_ms"), "added_ms"), r(change("recall"), "recall_change"), r(change("ndcg"), "ndcg_change"))
