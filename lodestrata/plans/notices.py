"""Notices of customers: pages and texts made from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import notices, spatial
from lodestrata.plans.places import SUMMARY_SQL, facilities, homes
from lodestrata.plans.registry import query
from lodestrata.plans.scalars import K, S, made
from lodestrata.session import shared_folder, table

PLATFORM = f"CASE {K} % 3 WHEN 0 THEN 'sohouse' WHEN 1 THEN 'cohouse' ELSE 'youth' END"
#: Ten shapes of a notice's text: other labels, none, blank values, tags, words instead of labels, amounts and areas.
_SHAPES = (
    f"concat('주택명 : 집 ', {S}, chr(10), '상호: <b>회사</b> ', {S}, chr(10), '대표자 : -', chr(10), '입주가능 : ', {S}, '호', chr(10), '주변 마트 정보: 가까운 곳')",
    f"concat('집구조: 복층 ', {S}, chr(10), '보증금 : ', {S}, ',000,000원', chr(10), '월세: 350,000원', chr(10), '관리비 : 50,000원')",
    f"concat('주택유형 : -', chr(10), '깨끗한 원룸 ', {S}, '호', chr(10), '지역/지구: 일반주거', chr(10), '규 모: 지상 3층', chr(10), '구  조: 철근')",
    f"concat('분리형 방 ', {S}, ' 개, 전용 20.5m² / 공용 ', {S}, '.5m²', chr(10), '대지면적 : 100㎡', chr(10), '연 면 적 : 200㎡ 그리고 100㎡')",
    f"concat('사용승인 : 2020-01-02', chr(10), '주 차: ', {S}, '대', chr(10), '총 세대 : 12', chr(10), '총 주거인원: 30', chr(10), '총 실 : 40')",
    f"concat('지하철역 : <i>신촌역</i>', chr(10), '버스정보: ', {S}, '번', chr(10), '주변병원정보 : 병원 ', {S}, chr(10), '주변 학교 정보: -')",
    f"concat('주변 시설 정보 : 공원', chr(10), '주변 카페  정보: 카페 ', {S}, chr(10), '홈페이지: https://example.org/', {S}, chr(10), '문의전화 : 02-123-', {S})",
    f"concat('입주대상: 청년', chr(10), '주거형태 : 다세대', chr(10), '입주가능일 : 2024.03.', {S}, chr(10), '특징: 조용함', chr(10), '설명 : ', {S}, ' 번째 집', chr(10), '테마:  ')",
    f"concat('주소 : 서울 ', {S}, chr(10), '주소: 부산', chr(10), '가격 000원 1,200,000원 1,200,000 원 55원')",
    "CAST(NULL AS STRING)",
)
DETAIL = f"CASE {K} % 10 " + " ".join(f"WHEN {i} THEN {shape}" for i, shape in enumerate(_SHAPES)) + " END"


def _plain_sql(x: str) -> str:
    for name, c in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{c}')"
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _field_sql(name: str) -> str:
    """The same labels, read by DuckDB."""
    said = lambda x: f"(CASE WHEN {_plain_sql(x)} NOT IN ({', '.join(repr(u) for u in notices.UNSAID)}) THEN {_plain_sql(x)} END)"
    tries = [said(f"nullif(trim(regexp_extract(t, '{label}\\s*:\\s*([^\\n]+)', 1)), '')") for label in notices.FIELDS[name]]
    if name == "unit_type":
        tries += [said(f"nullif(regexp_extract(t, '{word}', 1), '')") for word in notices.UNIT_WORDS]
    if name == "address":
        tries.append("CASE WHEN id % 2 = 0 THEN '길 ' || id END")
    value = f"coalesce({', '.join([*tries, 'NULL'])})"
    if name not in notices.PLATFORMS["youth"]:
        value = f"CASE WHEN platform <> 'youth' THEN {value} END"
    return f"{value} AS {name}"


def _facts_sql(name: str) -> str:
    """Distinct ones in order; RE2 has no look-behind, so amounts are cut out of longer runs of digits by a preceding sign."""
    pattern = notices.FACTS[name].replace("(?<![0-9])", "(?:^|[^0-9])")
    x = f"regexp_extract_all(coalesce({_plain_sql('t')}, ''), '{pattern}', 1)"
    x = f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
    return f"array_to_string(list_filter({x}, lambda v: NOT regexp_matches(v, '^0+$')), '|')" if name == "prices" else f"array_to_string({x}, '|')"


@query(
    "platform_fields",
    f"""WITH r AS (SELECT {K} AS id, {PLATFORM} AS platform, {DETAIL} AS t FROM customer)
SELECT id AS notice_id, platform, {', '.join(map(_field_sql, notices.FIELDS))}, {', '.join(f'{_facts_sql(n)} AS {n}' for n in notices.FACTS)},
  CASE WHEN regexp_matches(t, '전용\\s*[0-9.,]+\\s*m²\\s*/') THEN '전용 ' || regexp_extract(t, '전용\\s*([0-9.,]+)', 1) || 'm² / 공용 ' || regexp_extract(t, '공용\\s*([0-9.,]+)', 1) || 'm²' END AS area_text FROM r""",
)
def platform_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_platform_fields: wide records of three platforms, from the text or else the page's table, in one shape; ten shapes of text."""
    kv = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("address"), F.concat(F.lit("길 "), "id"), F.lit("theme"), F.lit("-"))).otherwise(F.create_map().cast("map<string,string>"))
    made_rows = made(spark, sf_dir, platform=PLATFORM, detail_text=DETAIL).withColumn("kv", kv).withColumnRenamed("id", "notice_id")
    held = notices.unified(made_rows)
    return held.select("notice_id", "platform", *notices.FIELDS, *[F.array_join(F.col("facts")[n], "|").alias(n) for n in notices.FACTS], "area_text")


HTML = f"""concat('<ul><li class="subway on"><p>지하철 정보</p></li><li class="subway"><p>', {K} % 9 + 1, '호선 </p></li><li>주변 마트 정보 <b>마트 ', {S}, '</b></li><li>주변 병원 정보</li></ul>',
 '<a class="x" href="/sohomeOfTheAreaList.do?id=', {S}, '">이웃 ', {S}, '</a><a href="/cohomeOfTheBizList.do"></a><a href="/sohomeOfTheBizList.do">같은 회사</a>')"""


@query(
    "facility_info",
    f"""SELECT {K} AS id, 'nearby_마트=마트 ' || {K} || '; subway=' || ({K} % 9 + 1) || '호선' AS facilities, '/sohomeOfTheAreaList.do?id=' || {K} || ' 이웃 ' || {K} AS area_links, '/sohomeOfTheBizList.do 같은 회사' AS business_links FROM customer""",
)
def facility_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_facility_info / related: facilities nearby and links to related houses."""
    html = F.col("html")
    shown = lambda links: F.array_join(F.transform(links, lambda x: F.concat_ws(" ", x["url"], x["title"])), "; ")
    entries = F.array_sort(F.transform(F.map_entries(notices.facilities(html)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    area, business = (shown(notices.related(html, notices.RELATED[k])) for k in ("nearby_housing", "same_business_housing"))
    return made(spark, sf_dir, html=HTML).select("id", F.array_join(entries, "; ").alias("facilities"), area.alias("area_links"), business.alias("business_links"))


UNIT_TEXT = f"""CASE {K} % 4 WHEN 0 THEN concat('전용 20.5㎡ 와 30㎡, 보증금 5,000,000원 월세 300,000원 관리비 70,000원') WHEN 1 THEN concat('15평 보증금 ', {K} % 900 + 100, '만원') WHEN 2 THEN '없음' ELSE NULL END"""


@query(
    "notice_units",
    f"""WITH c AS (SELECT {K} AS id FROM customer),
u AS (SELECT id, CASE id % 4 WHEN 0 THEN [20.5, 30.0]::DOUBLE[] WHEN 1 THEN [15.0]::DOUBLE[] ELSE []::DOUBLE[] END AS a, CASE id % 4 WHEN 0 THEN [5000000.0, 300000.0, 70000.0]::DOUBLE[] WHEN 1 THEN [id % 900 + 100, id % 900 + 100]::DOUBLE[] ELSE []::DOUBLE[] END AS p, id % 5 = 0 AS occupied, id % 4 = 3 AND id % 7 = 0 AS before FROM c),
v AS (SELECT id, CASE WHEN before THEN [40.0]::DOUBLE[] ELSE a END AS a, CASE WHEN before THEN [700000.0]::DOUBLE[] ELSE p END AS p FROM u WHERE NOT occupied),
n AS (SELECT *, greatest(len(a), len(p), 1) AS n FROM v), e AS (SELECT *, unnest(range(0, n)) AS i FROM n)
SELECT id AS notice_id, CAST(i AS INTEGER) AS unit_no, coalesce(a[i + 1], a[1]) AS area_m2, p[1] AS deposit, p[2] AS rent, p[3] AS fee, 'text' AS origin FROM e
UNION ALL SELECT id, 0, id * 1.0::DOUBLE, 1.0, 2.0, NULL, 'occupancy' FROM u WHERE occupied""",
)
def notice_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_from_notice: occupancy table first, then what was extracted before, then the text."""
    rows = made(spark, sf_dir, detail_text=UNIT_TEXT).withColumnRenamed("id", "notice_id")
    before, none = F.expr("notice_id % 4 = 3 AND notice_id % 7 = 0"), F.array().cast("array<double>")
    held = rows.withColumn("areas", F.when(before, F.array(F.lit(40.0))).otherwise(none)).withColumn("prices", F.when(before, F.array(F.lit(700000.0))).otherwise(none))
    occupancy = rows.where("notice_id % 5 = 0").select("notice_id", F.lit(0).alias("unit_no"), F.col("notice_id").cast("double").alias("area_m2"), F.lit(1.0).alias("deposit"), F.lit(2.0).alias("rent"))
    return notices.units(held, occupancy)


@query(
    "distance_example",
    f"""WITH {SUMMARY_SQL}, k(cd, label) AS (VALUES ('col', 'college'), ('park', 'park'), ('hos', 'hospital'), ('con', 'store'))
SELECT c.notice_id, h.title, f.name AS facility_name, k.label AS facility_type_name, distance_m FROM cached c JOIN h USING (notice_id) JOIN f USING (facility_id) JOIN k ON f.cd = k.cd WHERE c.notice_id = 7 ORDER BY distance_m, c.facility_id LIMIT 20""",
)
def distance_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_distance_4way_example: a home's twenty nearest facilities, of the cached distances, homes, facilities and their kinds."""
    kinds = spark.createDataFrame([("col", "college"), ("park", "park"), ("hos", "hospital"), ("con", "store")], "cd string, label string")
    h, f = homes(spark, sf_dir), facilities(spark, sf_dir)
    near = spatial.distances(h.where("notice_id = 7"), f).join(h.select("notice_id", "title"), "notice_id").join(f.select("facility_id", "name", "cd"), "facility_id").join(F.broadcast(kinds), "cd")  # four rows
    return near.orderBy("distance_m", "facility_id").limit(20).select("notice_id", "title", F.col("name").alias("facility_name"), F.col("label").alias("facility_type_name"), "distance_m")


@query("appended_batches", "SELECT o_orderkey, o_totalprice FROM orders")
def appended_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sink_insert_batch: a table filled by two appends; batches are the tasks of each write."""
    path = shared_folder(spark, "appended")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"):
        rows.where(part).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
