"""Sources and sinks: tables are written by a sink into the shared folder, read by a source, and compared with the tables."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyarrow.dataset import dataset
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import pages
from lodestrata.plans.registry import query
from lodestrata.session import shared_folder, table
from lodestrata.sources import files, paged, sinks


def lines(df: DataFrame, value: str, path: str) -> str:
    """Write one text line a row; the path."""
    df.select(F.expr(value).alias("value")).write.text(path)
    return path


@query(
    "rent_file_rows",
    "SELECT concat(l_orderkey, '-', l_linenumber) AS sigungu, printf('%.4f', l_quantity) AS area_m2, l_returnflag AS contract_type, CAST(l_suppkey AS VARCHAR) AS deposit_amount, CAST(NULL AS VARCHAR) AS floor FROM lineitem",
)
def rent_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_csv_typed, sink_csv_utf8sig: a rental file with a Korean header and a byte order mark; columns it lacks are null."""
    path = shared_folder(spark, "rent")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("시군구"), F.col("l_quantity").alias("전용면적(㎡)"), F.col("l_returnflag").alias("전월세구분"), F.col("l_suppkey").alias("보증금(만원)")
    )
    sinks.write_csv(rows, path)
    return files.rent_rows(spark, path).select("sigungu", "area_m2", "contract_type", "deposit_amount", "floor")


@query("charset_rows", "SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 10 = 0 THEN '서울 ' ELSE '' END || c_name AS name FROM customer")
def charset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_csv_auto_encoding: a file in a charset that only its last tenth tells."""
    path = shared_folder(spark, "charset")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("no"), F.concat(F.when(F.col("c_custkey") % 10 == 0, "서울 ").otherwise(""), "c_name").alias("title"))
    ordered = rows.coalesce(1).sortWithinPartitions(F.col("no") % 10 == 0, "no")  # a file, in order
    ordered.write.option("header", True).option("encoding", files.allow(spark, "MS949")).csv(path)
    return files.csv_any(spark, path, {"no": "key", "title": "name"})


@query("preamble_rows", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 16 AS INTEGER) AS line_no, n_nationkey, n_name FROM nation")
def preamble_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_csv_strip_preamble: fifteen lines of notes and a header before the rows."""
    path = shared_folder(spark, "preamble")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("no"), F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    notes = spark.range(-16, 0).select(F.col("id").cast("int").alias("no"), F.when(F.col("id") == -1, "key,name").otherwise(F.concat(F.lit("note "), "id")).alias("value"))
    nation.unionByName(notes).coalesce(1).sortWithinPartitions("no").select("value").write.text(path)  # a file, in order
    return files.csv_after_preamble(spark, f"{path}/part-*", "n_nationkey int, n_name string").select("line_no", "n_nationkey", "n_name")


@query(
    "code_file_rows",
    "WITH l AS (SELECT n_nationkey + 1 AS line_no, r_name AS name, lpad(n_nationkey::VARCHAR, 3, '0') AS code FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0) SELECT name, CAST(max(line_no) AS INTEGER) AS line_no, arg_max(code, line_no) AS code FROM l GROUP BY name",
)
def code_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_tsv_dong_codes, flt_status_exists: codes in force by name, the last line of a name wins."""
    path = shared_folder(spark, "codes")
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ordered = named.coalesce(1).sortWithinPartitions("n_nationkey")  # a file, in order
    lines(ordered, "concat_ws('\\t', lpad(string(n_nationkey), 3, '0'), r_name, if(n_nationkey % 4 = 0, '폐지', '존재'))", path)
    return files.dong_codes(spark, f"{path}/part-*")


@query("json_line_rows", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_jsonl, sink_jsonl_append: two appends, and lines that are no JSON."""
    path = shared_folder(spark, "json-lines")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    for part in ("c_custkey % 2 = 0", "c_custkey % 2 = 1"):
        sinks.append_json_lines(rows.where(part), path)
    return files.json_lines(spark, path, "c_custkey bigint, c_name string, c_acctbal double")[0]


@query("json_line_rejects", "SELECT '{' || s_name AS raw_data FROM supplier")
def json_line_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_jsonl: lines that are no JSON are kept apart."""
    path = shared_folder(spark, "json-rejects")
    sinks.append_json_lines(table(spark, sf_dir, "customer").select("c_custkey"), f"{path}/part=1")
    lines(table(spark, sf_dir, "supplier"), "concat('{', s_name)", f"{path}/part=2")
    return files.json_lines(spark, path, "c_custkey bigint")[1]


@query("json_array_rows", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey / 2 END AS half FROM nation")
def json_array_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_json_array, sink_json_array: a table as one array, not-a-number as null."""
    path = shared_folder(spark, "json-array")
    half = F.when(F.col("n_nationkey") % 5 == 0, float("nan")).otherwise(F.col("n_nationkey") / 2)
    lines(sinks.json_array_text(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", half.alias("half")), ["n_nationkey"]), "json", path)
    return files.json_array(spark, path, "n_nationkey int, n_name string, half double")


@query("platform_rows", "SELECT c_custkey AS notice_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment, CAST(0 AS BIGINT) AS n_units FROM customer")
def platform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_platform_dir, src_kv_json: a platform's folder without its file of units, and a file of extra values for some notices."""
    path = shared_folder(spark, "platform")
    rows = table(spark, sf_dir, "customer")
    rows.select(F.col("c_custkey").alias("notice_id"), F.col("c_name").alias("title")).write.json(f"{path}/notices.json")
    rows.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("notice_id"), F.create_map(F.lit("segment"), "c_mktsegment").alias("kv")).write.json(f"{path}/kv.json")
    held = files.platform(spark, path, {"notices": "notice_id bigint, title string", "units": "notice_id bigint, unit_no int", "kv": "notice_id bigint, kv map<string,string>"})
    per_notice = held["units"].groupBy(F.col("notice_id").alias("u_id")).agg(F.count(F.lit(1)).alias("n"))
    joined = files.with_sidecar(held["notices"], held["kv"], "notice_id").join(per_notice, F.col("notice_id") == F.col("u_id"), "left")
    return joined.select("notice_id", "title", F.try_element_at("kv", F.lit("segment")).alias("segment"), F.coalesce("n", F.lit(0)).alias("n_units"))


@query("latest_partition", "SELECT o_orderkey, o_totalprice, year(o_orderdate) AS date FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def latest_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_latest_partition, inc_date_partition, sink_truncate_reload: a load and its repetition, then the rows of the latest partition."""
    path = shared_folder(spark, "partitions")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("bigint").alias("date"))
    for _ in range(2):
        sinks.reload_partitions(rows, path, ["date"])
    return files.latest(spark.read.schema(rows.schema).parquet(path))


@query("xml_file_rows", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def xml_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_xml_paged_api, as files: the row elements of XML files."""
    path = shared_folder(spark, "xml")
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    rows.write.format("xml").option("rowTag", "row").option("rootTag", "rows").save(path)
    return files.xml_rows(spark, path, schema="id bigint, name string, balance double")


def suppliers(start: int, end: int, folder: str) -> str:
    """A page of a service that knows the rows of a Parquet folder, read from wherever it lies."""
    store, path = FileSystem.from_uri(folder)
    rows = dataset(path, filesystem=store, format="parquet")
    wanted = range(start - 1, min(end, total := rows.count_rows()))
    found = "".join(f"<row><key>{r['key']}</key><name>{escape(r['name'])}</name></row>" for r in rows.take(list(wanted)).to_pylist())
    return f"<list><list_total_count>{total}</list_total_count><RESULT><CODE>{paged.FINE}</CODE></RESULT>{found}</list>"


@query("xml_service_rows", "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier")
def xml_service_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_xml_paged_api: a partition for each page of a service over the suppliers."""
    folder = shared_folder(spark, "service")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).write.parquet(folder)
    spark.dataSource.register(paged.PagedXml)
    return spark.read.format("paged_xml").schema("key string, name string").option("fetch", f"{__name__}.suppliers").option("service", folder).option("page", "300").load()


@query(
    "query_file_rows",
    "SELECT 'query ' || item_id AS query, CASE WHEN item_id % 3 = 0 THEN '' WHEN item_id % 3 = 1 THEN 'k' || item_id ELSE 'k' || item_id || ',대출' END AS expected FROM benchmark",
)
def query_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_eval_queries: queries and their keywords, between comments and blank lines."""
    path = shared_folder(spark, "queries")
    each = "concat('# note\\n\\nquery ', item_id, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat(' | k', item_id) ELSE concat('|k', item_id, ' , 대출,') END)"
    lines(table(spark, sf_dir, "benchmark"), each, path)
    return files.eval_queries(spark, f"{path}/part-*").select("query", F.array_join("expected", ",").alias("expected"))


@query("merged_rows", "SELECT 'customer' AS kind, c_custkey AS key, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier")
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sink_merge_jsonl: tables of two categories as one file of JSON lines."""
    path = shared_folder(spark, "merged")
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    sinks.append_json_lines(sinks.merged([a, b]), path)
    return spark.read.schema("kind string, key bigint, segment string, balance double").json(path)


@query(
    "occupancy_rows",
    "SELECT o_orderkey AS page_id, CAST(0 AS INTEGER) AS row_no, o_orderstatus || '|' || CASE o_orderkey % 3 WHEN 0 THEN '입주 가능' WHEN 1 THEN '입주 불가능' ELSE '문의' END AS cells, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS available FROM orders",
)
def occupancy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_occupancy_table: the rows of an occupancy table in a page."""
    state = "CASE o_orderkey % 3 WHEN 0 THEN '입주 가능' WHEN 1 THEN '입주 불가능' ELSE '문의' END"
    html = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS page_id", f"concat('<table><tr><th>room</th></tr><tr class=x><td>', o_orderstatus, '</td><td> <b>', {state}, '</b></td></tr></table>') AS html")
    return pages.occupancy(html).select("page_id", "row_no", F.array_join("cells", "|").alias("cells"), "available")
