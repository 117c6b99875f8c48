"""Page layouts, grouped sections, kept-up statistics, checks, the encoder and the retrieval pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import dates
from lodestrata.functions import text as T
from lodestrata.operators import encoder, layout, pages, rag, refresh, rerank
from lodestrata.operators.lookup import small
from lodestrata.plans import rent, retrieval, text_sql
from lodestrata.plans.registry import query
from lodestrata.session import shared_folder, table

WORDS_SQL = f"w AS (SELECT url AS file, page_id AS page, list_filter(string_split({text_sql.plain('html')}, ' '), lambda x: x <> '') AS w FROM pages), e AS (SELECT file, page, generate_subscripts(w, 1) - 1 AS n, unnest(w) AS w FROM w)"


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every page on a grid of ten a line; each line is moved by its number modulo three."""
    placed = table(spark, sf_dir, "pages").select(F.col("url").alias("file"), F.col("page_id").alias("page"), F.posexplode(T.words(pages.plain(F.col("html")))).alias("seq", "text"))
    line = F.floor(F.col("seq") / 10).cast("int")
    return placed.select(
        "file", "page", "seq", "text", line.alias("line_no"), (F.col("seq") % 10 * 20.0 + line % 3).alias("x"), F.lit(3.0).alias("width"), (line * 12.0).alias("y"), (line * 12.0).alias("top"),
        F.lit(9.0).alias("size"), (F.col("seq") % 10 < F.when(line % 2 == 0, 3).otherwise(6)).cast("int").alias("bold"), F.lit(0.0).alias("shade"),
    )


@query("words_outside_boxes", f"WITH {WORDS_SQL} SELECT file, page, count(*) AS n_left FROM e WHERE NOT (n % 10 * 20 + n // 10 % 3 <= 100 AND n // 10 <= 1) GROUP BY ALL")
def words_outside_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pdf_exclude_boxes: a box over the left half of the first two lines of each page."""
    found = glyphs(spark, sf_dir)
    boxes = table(spark, sf_dir, "pages").select(F.col("url").alias("file"), F.col("page_id").alias("page"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("top0"), F.lit(100.0).alias("x1"), F.lit(12.0).alias("bottom1"))
    return layout.outside(found, boxes).groupBy("file", "page").agg(F.count(F.lit(1)).alias("n_left"))


@query(
    "bold_lines",
    f"WITH {WORDS_SQL}, l AS (SELECT file, page, n // 10 AS line_no, avg(CASE WHEN n % 10 < CASE WHEN n // 10 % 2 = 0 THEN 3 ELSE 6 END THEN 1.0 ELSE 0.0 END) AS bold FROM e GROUP BY ALL) SELECT file, page, count(*) AS n_lines, count(*) FILTER (WHERE bold >= 0.5) AS n_bold FROM l GROUP BY ALL",
)
def bold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pdf_bold_lines: lines half of whose signs are bold."""
    return layout.lines(glyphs(spark, sf_dir)).groupBy("file", "page").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("is_bold").alias("n_bold"))


@query(
    "page_tables",
    f"""WITH {WORDS_SQL}, l AS (SELECT file, page, n // 10 AS line_no, count(*) AS n, count(*) FILTER (WHERE regexp_matches(w, '[0-9]')) AS d, string_agg(w, ' ' ORDER BY n) AS words FROM e GROUP BY ALL),
p AS (SELECT file, page, count(*) AS n_rows, sum(n)::BIGINT AS n, sum(d) AS d, count(*) FILTER (WHERE d > 0) AS d_rows, string_agg(words, ' ' ORDER BY line_no) AS words FROM l GROUP BY file, page),
s AS (SELECT *, least(n, 10) AS n_columns, n_rows > 1 AND 50 + 20.0::DOUBLE * d_rows / n_rows > 40 + 40.0::DOUBLE * n / (n_rows * least(n, 10)) + 20.0::DOUBLE * d / n AS aligned FROM p)
SELECT file, page, CASE WHEN aligned THEN 'aligned' ELSE 'gaps' END AS strategy, n_rows::INTEGER AS n_rows, CASE WHEN aligned THEN 1 ELSE n_columns END::INTEGER AS n_columns, CASE WHEN aligned THEN n_rows ELSE n END::INTEGER AS n_filled, md5(words) AS words_md5
FROM s QUALIFY row_number() OVER (PARTITION BY file, words ORDER BY page) = 1""",
)
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pdf_best_tables, pdf_unique_tables: tables by gaps between columns and by aligned words, the better of them on each page, each table of a file once."""
    best = layout.best_tables(layout.table_candidates(glyphs(spark, sf_dir)))
    filled = F.filter(F.flatten("cells"), lambda c: c != "")
    return best.select("file", "page", "strategy", F.size("cells").alias("n_rows"), F.size(F.get("cells", F.lit(0))).alias("n_columns"), F.size(filled).alias("n_filled"), F.md5(F.array_join(filled, " ")).alias("words_md5"))


@query("table_cells", f"WITH {WORDS_SQL}, c AS (SELECT page, list_slice(w, 1, page % 5 + 1) AS c FROM w) SELECT page, CASE WHEN len(c) <= 3 THEN array_to_string(c, ' ') ELSE c[1] || '...' END AS cell FROM c")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pdf_table_cell: a cell of one to five lines, the first words of each page."""
    lines = F.slice(T.words(pages.plain(F.col("html"))), F.lit(1), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), layout.cell_text(lines).alias("cell"))


@query("file_outcomes", "SELECT count(*) AS total, count(*) FILTER (WHERE n_chars % 3 <> 0) AS succeeded, count(*) FILTER (WHERE n_chars % 3 = 0) AS failed FROM documents")
def file_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pdf_combine: files read and those with an error."""
    return layout.outcome(table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") % 3 == 0, "unreadable").alias("error")))


@query(
    "section_groups",
    """WITH s AS (SELECT 'f' || conv_id % 3 AS file, conv_id * 1000 + turn AS no, role AS title, text AS content, length(text) >= 100 AS large FROM conversations),
m AS (SELECT *, no = min(no) OVER (PARTITION BY file) AS head FROM s), a AS (SELECT *, last_value(CASE WHEN large OR head THEN title END IGNORE NULLS) OVER (PARTITION BY file ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM m),
g AS (SELECT *, max(CASE WHEN head OR (large AND title IS DISTINCT FROM prior) THEN no END) OVER (PARTITION BY file ORDER BY no) AS start FROM a)
SELECT file, start AS no, arg_min(title, no) AS title, md5(string_agg(content, chr(10) ORDER BY no)) AS content_md5 FROM g GROUP BY file, start""",
)
def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sec_group_related: messages as sections of three files, each in blocks."""
    turns = table(spark, sf_dir, "conversations")
    sections = turns.select(F.concat(F.lit("f"), (F.col("conv_id") % 3).cast("string")).alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("no"), F.col("role").alias("title"), F.col("text").alias("content"))
    return layout.grouped_sections(sections, block=5000).select("file", "no", "title", F.md5("content").alias("content_md5"))


@query(
    "checked_rows",
    """SELECT c_custkey AS id, coalesce(regexp_matches(email, '(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}$'), true) AS email, coalesce(role IN ('user', 'admin'), true) AS role
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'u' || c_custkey || '@example.org' WHEN 1 THEN c_name WHEN 2 THEN c_name || '@x.y' END AS email, CASE WHEN c_custkey % 3 > 0 THEN 'user' ELSE c_mktsegment END AS role FROM customer)""",
)
def checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_regex_check: which checks of its table a row passes."""
    users = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "CASE c_custkey % 4 WHEN 0 THEN concat('u', c_custkey, '@example.org') WHEN 1 THEN c_name WHEN 2 THEN concat(c_name, '@x.y') END AS email", "CASE WHEN c_custkey % 3 > 0 THEN 'user' ELSE c_mktsegment END AS role"
    )
    return users.select("id", *[rule.alias(name) for name, rule in schemas.checks("users").items()])


@query(
    "refreshed_statistics",
    f"""SELECT building_type, emd_code, area_range, min(sigungudong) AS sigungudong, count(*) AS transaction_count, ((2 * sum(CAST(round(converted_price * 100) AS BIGINT)) + count(*)) // (2 * count(*)))::DOUBLE / 100 AS avg_converted_price,
  min(contract_year_month) AS period_start_ym, max(contract_year_month) AS period_end_ym FROM ({rent.TRANS_SQL}) WHERE converted_price IS NOT NULL AND area_range IS NOT NULL AND emd_code IS NOT NULL AND contract_year_month >= {rent.FLOOR_YM} GROUP BY building_type, emd_code, area_range""",
)
def refreshed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """void procedure (refresh), agg_statistics_rent: four batches, two of them loaded twice, give the statistics of everything."""
    path = shared_folder(spark, "statistics")
    rows = rent.transactions(spark, sf_dir).withColumn("batch", F.pmod(F.xxhash64("sigungudong", "contract_year_month"), F.lit(4)))
    for number in (0, 1, 1, 2, 3, 0):
        refresh.load(rows.where(F.col("batch") == number), number, path, rent.FLOOR_YM)
    return refresh.statistics(spark, path)


@query(
    "order_windows",
    """WITH b AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders), w AS (SELECT i AS window_no, (lo + to_years(i::INTEGER))::DATE AS window_start, least(((lo + to_years(i::INTEGER + 1))::DATE - 1), hi) AS window_end FROM b, range(0, 100) t(i) WHERE (lo + to_years(i::INTEGER))::DATE <= hi)
SELECT window_no::INTEGER AS window_no, window_start, window_end, count(o_orderkey) AS n_orders FROM w LEFT JOIN orders ON o_orderdate::DATE BETWEEN window_start AND window_end GROUP BY ALL""",
)
def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt_windows: the years from the first order on, and their orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    first, last = orders.agg(F.min("day"), F.max("day")).first()
    windows = F.broadcast(dates.yearly_windows(spark, str(first), str(last)))  # a row a year
    days = orders.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    held = windows.join(days, F.col("day").between(F.col("window_start"), F.col("window_end")), "left")
    return held.groupBy("window_no", "window_start", "window_end").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"))


VECTOR_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
VECTOR_CANDIDATES = f"""items AS (SELECT vec_id AS item_id, d.text AS query FROM embeddings JOIN documents d ON doc_id = vec_id WHERE vec_id % 20 = 0),
cand AS (SELECT q.vec_id AS query_id, i.query, e.vec_id AS doc_id, d.text AS content, {VECTOR_COS} AS similarity, d.doc_id % 7 AS chunk_index FROM embeddings q JOIN items i ON i.item_id = q.vec_id, embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE {VECTOR_COS} >= 0.0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {VECTOR_COS} DESC, e.vec_id) <= 5)"""


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the vector of their id as chunks, and those whose id is divisible by 20 as queries."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), (F.col("doc_id") % 7).cast("int").alias("chunk_index"))
    held = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    return held, held.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("content").alias("query"), F.col("embedding").alias("query_embedding"))


@query("rag_search", f"WITH {VECTOR_CANDIDATES} SELECT query_id, doc_id AS id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS INTEGER) AS rank, round(similarity, 6) AS similarity, chunk_index::INTEGER AS chunk_index FROM cand")
def rag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rag_search_only, join_chunk_embedding: chunks and their vectors, and the five nearest of each query with their contents."""
    return rag.searched(*_chunks(spark, sf_dir)).select("query_id", "id", F.col("prior_rank").alias("rank"), F.round("similarity", 6).alias("similarity"), "chunk_index")


@query("rag_answers", f"SELECT query_id, n_chars, context_md5, '답: ' || substr(context, 1, 40) AS answer FROM ({text_sql.contexts(VECTOR_CANDIDATES)}) WHERE layout = 'prompt'")
def rag_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rag_retrieve_augment, rag_augment_only, rag_generate: contexts of the nearest chunks, and what a generator, here a prefix, makes of them."""
    held, queries = _chunks(spark, sf_dir)
    results = rag.searched(held, queries).withColumn("source", F.concat(F.lit("doc "), F.col("id").cast("string")))
    made = rag.answered(rag.augmented(results, queries), lambda c: F.concat(F.lit("답: "), F.substring(c, 1, 40)))
    return made.select("query_id", F.col("n_chars"), F.md5("context").alias("context_md5"), "answer")


@query(
    "semantic_rerank",
    f"""WITH {retrieval.CANDIDATES_SQL}, s AS (SELECT query_id, cand.doc_id, similarity, {VECTOR_COS} AS c FROM cand LEFT JOIN embeddings q ON q.vec_id = query_id LEFT JOIN embeddings e ON e.vec_id = cand.doc_id)
SELECT query_id, doc_id, round(coalesce(c, similarity), 6) AS semantic_score, round(CASE WHEN c IS NULL THEN similarity ELSE similarity * 0.6 + c * 0.4 END, 6) AS rerank_score FROM s""",
)
def semantic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rerank_semantic: candidates of the text index by the vectors of both ids; where one is missing the similarity stays."""
    best = retrieval.kept(retrieval.found(spark, sf_dir))
    # Vectors of these ids alone are moved.
    asked = best.select(F.explode(F.array("query_id", "doc_id")).alias("vec_id")).distinct()
    vectors = table(spark, sf_dir, "embeddings").join(small(asked), "vec_id", "left_semi")
    of = lambda key, name: vectors.select(F.col("vec_id").alias(key), F.col("embedding").alias(name))
    both = best.join(of("query_id", "query_embedding"), "query_id", "left").join(of("doc_id", "content_embedding"), "doc_id", "left")
    return rerank.by_meaning(both).select("query_id", "doc_id", F.round("semantic_score", 6).alias("semantic_score"), F.round("rerank_score", 6).alias("rerank_score"))


@query("encoded_documents", f"SELECT doc_id, {encoder.DIMENSIONS} AS n_dimensions, len({retrieval.TOKEN_SQL.format(c=chr(116) + 'ext')}) = 0 AS is_zero FROM documents")
def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_encode_documents: all documents by an encoder fitted on them; the tests hold its neighbours against exact weights."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    made = encoder.encode(docs, encoder.fit(docs))
    return made.select(F.col("id").alias("doc_id"), F.size("embedding").alias("n_dimensions"), (~F.exists("embedding", lambda x: x != 0)).alias("is_zero"))
