"""Cleaning, chunking, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import chunks, conversations, layout, pages, sqlguard
from lodestrata.plans import text_sql
from lodestrata.plans.registry import query
from lodestrata.session import table


@query("chunk_chars", text_sql.CHUNK_CHARS)
def chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_chars, win_chunk_index over whole documents."""
    return chunks.chunked(table(spark, sf_dir, "documents"), "windows")


@query("chunk_sentences", text_sql.CHUNK_SENTENCES)
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_section for text: whole sentences with overlap."""
    return chunks.chunked(table(spark, sf_dir, "documents"), "sentences")


@query("chunk_sections", text_sql.CHUNK_SECTIONS)
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_section: documents as two sections, a titled text and a table of its lines."""
    rows = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("| "), x, F.lit(" |")))
    kind = "array<struct<id:string,type:string,title:string,content:array<string>>>"
    both = F.array(
        F.struct(F.lit("s1").alias("id"), F.lit("text").alias("type"), F.col("source").alias("title"), F.split("text", "\n").alias("content")),
        F.struct(F.lit("s2").alias("id"), F.lit("table").alias("type"), F.lit("").alias("title"), F.concat(F.array(F.lit("| h |"), F.lit("|---|")), rows).alias("content")),
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_name"), both.cast(kind).alias("sections"))
    return chunks.sections(docs)


@query("clean_ocr", text_sql.CLEAN_OCR)
def clean_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_clean_ocr, str_remove_hidden_layers, str_remove_headers_footers, str_normalize_bullets over whole documents."""
    cleaned = T.with_bullets(T.without_headers(T.clean_ocr(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", cleaned.alias("cleaned"))


@query("sentence_split", text_sql.SENTENCES)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_split_sentences: a row for each sentence."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence"))


@query("paragraph_types", text_sql.PARAGRAPH_TYPES)
def paragraph_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_paragraphs, str_paragraph_type, str_paragraph_resize, sec_title_level over the lines of documents."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) != ''")
    line = F.col("line")
    return each.select("doc_id", "line_no", T.paragraph_type(line).alias("kind"), T.paragraph_title(line).alias("title"), T.title_level(line).alias("level"), F.size(T.fitted(line)).alias("n_pieces"))


@query(
    "squeezed_text",
    "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\s+([.,!?])', '\\1', 'g'))) AS squeezed_md5, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents",
)
def squeezed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_clean_format, str_stopwords / tokenise."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.squeezed(t)).alias("squeezed_md5"), F.size(T.words(t)).cast("bigint").alias("n_words"))


@query(
    "strip_tags",
    """SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages""",
)
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_strip_tags."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.without_tags(F.col("html"))).alias("text_md5"))


@query("page_fields", text_sql.PAGE_FIELDS)
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_core_content, page_title_clean, page_building_form, page_last_modified, page_address_strict, page_text_info, page_attachments, str_label_value, str_eligibility, str_subway_tokens."""
    html = F.col("html")
    held = table(spark, sf_dir, "pages").select("page_id", "url", "html", pages.plain(html).alias("plain"))
    plain = F.col("plain")
    info = pages.details(plain)
    return held.select(
        "page_id", pages.house_name(pages.title(html), F.col("url")).alias("name"), pages.building_form(plain).alias("form"), pages.last_modified(plain).alias("modified"), pages.address(plain, pages.label_value(html, ["주소", "소재지"])).alias("address"),
        F.array_join(info["amenities"], ",").alias("amenities"), F.array_join(info["money"], ",").alias("money"), F.size(pages.attachments(html, F.col("url"))).alias("n_files"), pages.eligibility(plain).alias("eligibility"),
        pages.stations(pages.subway(plain)).alias("stations"),
    )


@query(
    "page_text_sizes",
    "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_html, CAST(len(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']')) AS BIGINT) AS n_links FROM pages",
)
def page_text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_html_pages: links of each page."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("n_html"), F.size(links).cast("bigint").alias("n_links"))


@query("page_lines", text_sql.PAGE_LINES)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pdf_visible_chars, pdf_lines, pdf_paragraphs: each page's words as characters on a grid, ten a line."""
    words = F.posexplode(T.words(pages.plain(F.col("html")))).alias("seq", "text")
    placed = table(spark, sf_dir, "pages").select(F.col("url").alias("file"), F.col("page_id").alias("page"), words)
    n = F.col("seq")
    chars = placed.select(
        "file", "page", "seq", "text", (n % 10 * 20.0).alias("x"), (F.floor(n / 10) * 12.0 + n % 3).cast("double").alias("y"), (F.floor(n / 10) * 12.0 + n % 3).cast("double").alias("top"), F.lit(9.0).alias("size"),
        (n < 10).cast("int").alias("bold"), F.lit(0.0).alias("shade"),
    )
    return layout.paragraphs(layout.lines(layout.visible(chars)))


NUMBERED_SQL = "n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


BATCHES_SQL = f"""WITH {NUMBERED_SQL} SELECT conv_id, CAST(floor((no - 1) / 10) AS BIGINT) AS batch_no, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_messages, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY no) AS content
FROM n WHERE no <= n - 10 GROUP BY conv_id, floor((no - 1) / 10)"""


@query("conversation_batches", BATCHES_SQL)
def conversation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_memory, win_conversation_batches."""
    return conversations.batches(table(spark, sf_dir, "conversations"))


@query("recent_window", f"WITH {NUMBERED_SQL} SELECT conv_id, turn, role, text FROM n WHERE n - no >= 1 AND (n - no <= 9 OR n <= 10)")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recent window of a prompt, without the overlap."""
    return conversations.recent(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@query("recent_window_observed", f"WITH {NUMBERED_SQL} SELECT conv_id, turn, role FROM n WHERE n - no >= 1 AND (n - no <= 10 OR n <= 10)")
def recent_window_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recent window as observed: the eleventh last message is repeated."""
    return conversations.recent(table(spark, sf_dir, "conversations"), fixed=False).select("conv_id", "turn", "role")


@query("recent_conversations", "SELECT conv_id, count(*) AS n_messages, max(turn) AS updated_turn FROM conversations GROUP BY conv_id ORDER BY updated_turn DESC, conv_id LIMIT 10 OFFSET 10")
def recent_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topk_recent_conversations: the second page of ten."""
    return conversations.latest(table(spark, sf_dir, "conversations"), 10, 10)


@query("last_questions", "SELECT conv_id, max_by(text, turn) AS question, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message that a prompt answers."""
    return conversations.last_question(table(spark, sf_dir, "conversations"))


@query("owned_messages", "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE conv_id % 5 = 2)")
def owned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_permission, sort_messages: conversations belong to five users in turn."""
    m = table(spark, sf_dir, "conversations")
    own = m.select("conv_id").distinct().withColumn("user_id", F.concat(F.lit("u"), (F.col("conv_id") % 5).cast("string")))
    return conversations.owned(m, own, "u2").select("conv_id", "turn")


@query("encrypted_round_trip", "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations")
def encrypted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crypt_text: encrypted and decrypted again; a nonce keeps equal texts apart in between."""
    key = "0123456789abcdef"
    m = conversations.decrypted(conversations.encrypted(table(spark, sf_dir, "conversations"), key), key)
    return m.select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query("titles", text_sql.TITLES)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_title_clean, str_title_cut, str_title_fallback over all messages."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.short_title(t).alias("short"), T.cut_title(T.without_greeting(t)).alias("cut"), T.fallback_title(t).alias("fallback"))


GUARDED = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name"


@query("sql_guard", f"{GUARDED} LIMIT 10")
def sql_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_pg_query, limit_10_default: a generated statement behind the guard."""
    for name in ("customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return sqlguard.select(spark, GUARDED + ";", {"customer", "nation"})
