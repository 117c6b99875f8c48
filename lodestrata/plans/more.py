"""Further scalar families: paths, hashes, keywords, points, pooled vectors, conditions and tables in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import address, hashing, money, vectors
from lodestrata.functions import text as T
from lodestrata.operators import pages
from lodestrata.plans.registry import query
from lodestrata.plans.scalars import K, S, made, made_sql
from lodestrata.session import table

PATH = f"CASE {K} % 4 WHEN 0 THEN concat('/data/raw/', {S}, '/plan.PDF') WHEN 1 THEN concat('/elsewhere/', {S}, '.jpeg') WHEN 2 THEN concat('/data/raw/', {S}) ELSE NULL END"


@query(
    "path_text",
    f"""WITH t AS ({made_sql(p=PATH)}) SELECT id, CASE WHEN starts_with(p, '/data/raw/') THEN substr(p, 11) ELSE p END AS relative,
  CASE lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime, concat_ws(';', p, 'x.png') AS joined FROM t""",
)
def path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_relative_path, str_guess_mime, arr_join_paths: null paths are left out of a joined list."""
    p = F.col("p")
    relative = T.relative_path(p, "/data/raw")
    return made(spark, sf_dir, p=PATH).select("id", relative.alias("relative"), T.mime_type(p).alias("mime"), T.joined_paths(F.array(p, F.lit("x.png"))).alias("joined"))


@query("url_hashes", "SELECT page_id, regexp_replace(url || '?a=1#top', '[?#].*$', '') AS url_key, sha256(html) AS content_hash FROM pages")
def url_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_url / hash_bytes: a url without query and fragment, and a hash of the whole page."""
    return table(spark, sf_dir, "pages").select("page_id", hashing.url_key(F.concat("url", F.lit("?a=1#top"))).alias("url_key"), hashing.content_hash(F.col("html")).alias("content_hash"))


TITLE = f"CASE {K} % 5 WHEN 0 THEN '2024 입주자 모집공고' WHEN 1 THEN 'Seoul 행복주택' WHEN 2 THEN '수도권 안내' WHEN 3 THEN '입주자모집 (부산)' ELSE NULL END"


@query("announcement_titles", f"WITH t AS ({made_sql(t=TITLE)}) SELECT id, t AS title FROM t WHERE regexp_matches(t, '모집\\s?공고|입주자\\s?모집') OR regexp_matches(lower(t), '서울|seoul|수도권')")
def announcement_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_title_announcement, of either board."""
    t = F.col("t")
    return made(spark, sf_dir, t=TITLE).where(pages.announcement("A", t) | pages.announcement("B", t)).select("id", F.col("t").alias("title"))


@query("normalised_scores", "SELECT c_custkey, c_mktsegment, CASE WHEN hi = lo THEN 0.5 ELSE round((c_acctbal - lo) / (hi - lo), 9) END AS score FROM customer JOIN (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY c_mktsegment) USING (c_mktsegment)")
def normalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num_minmax_norm within segments; bounds are aggregated, then joined."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    bounds = c.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return c.join(bounds, "c_mktsegment").select("c_custkey", "c_mktsegment", F.round(money.normalised(F.col("c_acctbal"), F.col("lo"), F.col("hi")), 9).alias("score"))


@query(
    "keyword_lists",
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), ','), ','), lambda k: regexp_replace(lower(trim(k)), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}]', '', 'g')), lambda k: length(k) >= 2), '|') AS keywords FROM documents",
)
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arr_keywords_parse over whole documents as comma-separated lists."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keyword_list(F.col("text")), "|").alias("keywords"))


@query("bus_points", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE printf('%.1f', c_custkey + 0.5) || ',' || printf('%.1f', c_nationkey + 0.5) END AS point, CASE WHEN c_custkey % 3 <> 0 THEN 'x' END AS has_x FROM customer")
def bus_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_bus_stop, geo_point, prj_api_or_csv_coord: both coordinates as numbers, or blank."""
    x = F.when(F.col("c_custkey") % 3 == 0, "-").otherwise((F.col("c_custkey") + 0.5).cast("string"))
    c = table(spark, sf_dir, "customer").withColumn("point", address.bus_point(x, (F.col("c_nationkey") + 0.5).cast("string")))
    return c.select("c_custkey", "point", F.when(F.col("point") != "", "x").alias("has_x"))


@query(
    "pooled_vectors",
    """WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding, lambda x: (x * 2 + 1)::DOUBLE) AS b FROM embeddings), p AS (SELECT vec_id, list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2) AS mean, list_transform(list_zip(a, b), lambda z: greatest(z[1], z[2])) AS top, a FROM t)
SELECT vec_id, round(mean[1] / sqrt(list_sum(list_transform(mean, lambda x: x * x))), 9) AS mean_1, round(top[1] / sqrt(list_sum(list_transform(top, lambda x: x * x))), 9) AS max_1, round(a[2] / sqrt(list_sum(list_transform(a, lambda x: x * x))), 9) AS cls_2,
  round(list_cosine_similarity(a, mean), 9) AS similarity FROM p""",
)
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_pool, vec_cosine_py: the pools of two shown tokens and a masked one."""
    a = F.transform("embedding", lambda x: x.cast("double"))
    tokens = F.array(a, F.transform("embedding", lambda x: (x * F.lit(2).cast("float") + F.lit(1).cast("float")).cast("double")), F.transform(a, lambda x: F.lit(9.0)))
    mask = F.array(F.lit(1), F.lit(1), F.lit(0))
    pool = lambda how: vectors.pooled(tokens, mask, how)
    at = lambda v, i: F.round(F.get(v, F.lit(i)), 9)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", at(pool("mean"), 0).alias("mean_1"), at(pool("max"), 0).alias("max_1"), at(pool("cls"), 1).alias("cls_2"), F.round(vectors.bound(pool("mean"), lambda m: vectors.cosine(a, m)), 9).alias("similarity")
    )


@query("json_built", """SELECT c_custkey, '{"id":' || c_custkey || ',"name":"' || c_name || '","tags":["' || c_mktsegment || '"]}' AS json FROM customer""")
def json_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """json_build: an object of named values and an array."""
    built = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tags")))
    return table(spark, sf_dir, "customer").select("c_custkey", built.alias("json"))


@query("preserved_order", "SELECT l_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS flags FROM (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS l FROM lineitem GROUP BY l_orderkey)")
def preserved_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_dedupe_preserve_order: the flags of an order's lines, each where it comes first."""
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("l"))
    return each.select("l_orderkey", F.array_join(F.array_distinct(F.transform("l", lambda x: x["l_returnflag"])), ",").alias("flags"))


FAQ = f"CASE {K} % 4 WHEN 0 THEN concat('Q1. 자격이 되나요 네 가능한 사람 ', {S}, '명입니다. Q2. ') WHEN 1 THEN concat('질문내용\\n1. 대상은 ', {S}, '?\\n설명') WHEN 2 THEN concat('첫 문단 ', {S}, '\\n\\n다음') ELSE NULL END"
FAQ_SQL = FAQ.replace("\\n", "' || chr(10) || '")


@query(
    "faq_texts",
    f"""WITH t AS ({made_sql(t=FAQ_SQL)}) SELECT id, CASE id % 4 WHEN 0 THEN '**Q1.** / **답변:** 자격이 되나요 네 가능한 사람 ' || id || '명입니다.' WHEN 1 THEN '**질문:** 대상은 ' || id || '?' WHEN 2 THEN '첫 문단 ' || id || ' / 다음' END AS parts,
  regexp_matches(t, 'Q[0-9]+\\.|질문\\s*내용') AS is_faq FROM t""",
)
def faq_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_is_faq / faq splitters, str_clean_answer: numbered answers, questions alone, plain paragraphs."""
    t = F.col("t")
    return made(spark, sf_dir, t=FAQ).select("id", F.array_join(T.faq(t), " / ").alias("parts"), T.is_faq(t).alias("is_faq"))


@query("markdown_tables", "SELECT l_orderkey, '| no | flag |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_returnflag || ' |', chr(10) ORDER BY l_linenumber, l_returnflag) AS markdown, count(*) + 1 AS n_rows FROM lineitem GROUP BY l_orderkey")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_table_markdown / clean / post, str_table_rows: a table for each order, and its rows read back."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda r: F.array(r["l_linenumber"].cast("string"), r["l_returnflag"]))
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(cells.alias("cells"))
    whole = each.select("l_orderkey", T.markdown_table(F.concat(F.array(F.array(F.lit("no"), F.lit("flag")), F.array(F.lit(""), F.lit(None).cast("string"))), "cells")).alias("markdown"))
    return whole.select("l_orderkey", "markdown", F.size(T.table_rows(F.col("markdown"))).cast("bigint").alias("n_rows"))
