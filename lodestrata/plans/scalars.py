"""Scalar families over texts made from customer and orders keys; each engine computes the texts from the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import address, casts, codes, dates, hashing, money
from lodestrata.functions import text as T
from lodestrata.plans.registry import query
from lodestrata.session import table

K = "c_custkey"
S = f"CAST({K} AS STRING)"

MONEY = f"""CASE {K} % 9 WHEN 0 THEN concat({S}, '만원') WHEN 1 THEN concat({S}, '억원') WHEN 2 THEN concat({S}, ',000원') WHEN 3 THEN '문의'
 WHEN 4 THEN concat('1억 ', {S}, '만원') WHEN 5 THEN '0원' WHEN 6 THEN concat('보증금 ', {S}, ',000 원 월세 1,', {S}, '000') WHEN 7 THEN '' ELSE NULL END"""


def made(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """Customers with texts made by SQL expressions that DuckDB understands too."""
    return table(spark, sf_dir, "customer").selectExpr(f"{K} AS id", *[f"{e} AS {n}" for n, e in columns.items()])


def made_sql(**columns: str) -> str:
    return f"SELECT {K} AS id, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM customer"


@query(
    "money_text",
    f"""WITH t AS ({made_sql(t=MONEY)}), n AS (SELECT *, TRY_CAST(replace(regexp_extract(t, '[0-9,]+'), ',', '') AS BIGINT) AS first,
  TRY_CAST(replace(regexp_extract(t, '([0-9][0-9,]*)\\s*(만원|원)', 1), ',', '') AS BIGINT) AS token, regexp_extract(t, '([0-9][0-9,]*)\\s*(만원|원)', 2) AS unit FROM t)
SELECT id, CASE WHEN contains(t, '만원') THEN first * 10000 WHEN contains(t, '억원') THEN first * 100000000 ELSE first END AS krw,
  CASE WHEN unit = '만원' THEN token * 10000 ELSE token END AS token_won,
  CASE WHEN NOT (regexp_matches(trim(t), '문의|상담|협의|전화|연락') OR trim(t) IN ('', '0원', '0')) THEN trim(t) END AS price_text,
  TRY_CAST(regexp_extract(t, '[0-9]+') AS BIGINT) AS first_number, CAST(floor(length(t) / 1.5) AS BIGINT) AS tokens FROM n""",
)
def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num_krw_parse, num_money_simple, num_price_text, num_parse_numeric, num_token_estimate."""
    t = F.col("t")
    return made(spark, sf_dir, t=MONEY).select(
        "id", money.krw_amount(t).alias("krw"), money.money_token(t).alias("token_won"), money.price_text(t).alias("price_text"), money.first_number(t).alias("first_number"), money.token_estimate(t).alias("tokens")
    )


AREA = f"""CASE {K} % 5 WHEN 0 THEN concat('전용 ', {S}, '.5㎡') WHEN 1 THEN concat({S}, ' 평') WHEN 2 THEN concat({S}, 'm2') WHEN 3 THEN '면적 미정' ELSE NULL END"""
ROOM = f"CASE {K} % 5 WHEN 0 THEN '원룸형' WHEN 1 THEN '투룸' WHEN 2 THEN '쓰리룸' WHEN 3 THEN '3룸 복층' ELSE '기타' END"


@query(
    "area_text",
    f"""WITH t AS ({made_sql(t=AREA, r=ROOM)}), n AS (SELECT *, TRY_CAST(regexp_extract(t, '([0-9]+(?:\\.[0-9]+)?)\\s*(㎡|m2|제곱미터|평)', 1) AS DOUBLE) AS v,
  regexp_extract(t, '([0-9]+(?:\\.[0-9]+)?)\\s*(㎡|m2|제곱미터|평)', 2) AS unit FROM t)
SELECT id, round(CASE WHEN unit = '평' THEN v * 3.3058 ELSE v END, 6) AS area_m2, coalesce(regexp_matches(t, 'm²|㎡|m2|평|전용|공급|면적|/|~|이상|이하|범위'), false) AS is_area,
  CASE WHEN contains(r, '원룸') THEN 1 WHEN contains(r, '투룸') THEN 2 WHEN contains(r, '쓰리룸') OR contains(r, '3룸') THEN 3 ELSE 1 END AS rooms FROM n""",
)
def area_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num_area, flag_area_text, prj_room_count."""
    t = F.col("t")
    return made(spark, sf_dir, t=AREA, r=ROOM).select("id", F.round(money.area_token(t), 6).alias("area_m2"), codes.looks_like_area(t).alias("is_area"), money.room_count(F.col("r")).alias("rooms"))


RANGE = f"CASE {K} % 4 WHEN 0 THEN concat('2,', lpad({S}, 3, '0'), ' ~ 1,000') WHEN 1 THEN '5,000,000 원' WHEN 2 THEN 'none 12' ELSE NULL END"


@query(
    "money_range",
    f"""WITH t AS ({made_sql(t=RANGE)}), n AS (SELECT id, list_transform(regexp_extract_all(t, '\\b[0-9]{{1,3}}(?:,[0-9]{{3}})+\\b'), lambda x: CAST(replace(x, ',', '') AS BIGINT)) AS a FROM t)
SELECT id, least(a[1], coalesce(a[2], a[1])) AS low, greatest(a[1], coalesce(a[2], a[1])) AS high FROM n""",
)
def money_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num_money_range."""
    return made(spark, sf_dir, t=RANGE).select("id", money.money_range(F.col("t")).alias("r")).select("id", "r.low", "r.high")


@query(
    "anomaly_fix",
    """WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE CAST(floor(c_acctbal * 20) AS BIGINT) END AS amount FROM customer),
f AS (SELECT *, CASE WHEN amount = 0 THEN NULL WHEN amount < 100000 THEN amount * 10000 ELSE amount END AS deposit,
  CASE WHEN amount = 0 THEN NULL WHEN amount < 10000 THEN amount * 10000 ELSE amount END AS rent FROM t)
SELECT id, deposit, rent, CASE WHEN amount <> 0 AND deposit / amount >= 10000 THEN '만원' ELSE '원' END AS scale FROM f""",
)
def anomaly_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num_anomaly_fix, num_amount_scale."""
    t = table(spark, sf_dir, "customer").select(F.col(K).alias("id"), F.when(F.col(K) % 7 == 0, 0).otherwise(F.floor(F.col("c_acctbal") * 20)).cast("bigint").alias("amount"))
    f = t.withColumn("deposit", money.fix_anomaly(F.col("amount"), "deposit")).withColumn("rent", money.fix_anomaly(F.col("amount"), "rent"))
    return f.select("id", "deposit", "rent", money.amount_scale(F.col("amount"), F.col("deposit")).alias("scale"))


NUMBER = f"CASE {K} % 7 WHEN 0 THEN '12.5' WHEN 1 THEN concat(' ', {S}, ' ') WHEN 2 THEN 'nan' WHEN 3 THEN '' WHEN 4 THEN '-3.9' WHEN 5 THEN 'x1' ELSE NULL END"


@query(
    "safe_casts",
    f"""WITH t AS ({made_sql(t=NUMBER)}), n AS (SELECT *, CASE WHEN lower(trim(t)) <> 'nan' THEN TRY_CAST(trim(t) AS DOUBLE) END AS f FROM t)
SELECT id, f AS as_float, CAST(trunc(f) AS BIGINT) AS as_int, CASE WHEN trim(t) <> '' AND lower(trim(t)) <> 'nan' THEN substring(trim(t), 1, 3) END AS as_text,
  CASE WHEN trim(t) <> '' THEN t END AS not_blank, coalesce(trim(t) NOT IN ('', 'nan'), false) AS is_there FROM n""",
)
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_safe_cast, prj_blank_to_null, prj_nan_to_null, prj_notice flags."""
    t = F.col("t")
    return made(spark, sf_dir, t=NUMBER).select(
        "id", casts.safe_float(t).alias("as_float"), casts.safe_int(t).alias("as_int"), casts.safe_text(t, 3).alias("as_text"), casts.blank_to_null(t).alias("not_blank"), casts.present(t).alias("is_there")
    )


DATE = f"""CASE {K} % 6 WHEN 0 THEN concat('20', lpad(CAST({K} % 30 AS STRING), 2, '0'), '.3.', CAST({K} % 28 + 1 AS STRING)) WHEN 1 THEN concat('접수 2024년 ', CAST({K} % 12 + 1 AS STRING), '월 5일')
 WHEN 2 THEN '1970-01-01' WHEN 3 THEN 'nan' WHEN 4 THEN '2023-11-02' ELSE NULL END"""
DATE_SQL = r"'(20[0-9]{2})[.\-년/ ]\s*([0-9]{1,2})[.\-월/ ]\s*([0-9]{1,2})'"


@query(
    "date_text",
    f"""WITH t AS ({made_sql(t=DATE)}), n AS (SELECT *, regexp_extract(t, {DATE_SQL}, 1) AS y, regexp_extract(t, {DATE_SQL}, 2) AS m, regexp_extract(t, {DATE_SQL}, 3) AS d FROM t)
SELECT id, CASE WHEN y <> '' THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') END AS iso,
  CASE WHEN t NOT IN ('', '1970-01-01', '1970-01-01T00:00:00', 'nan') THEN t END AS no_epoch, TRY_CAST(CASE WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN t
  WHEN regexp_matches(t, '^[0-9]{{4}}\\.[0-9]{{2}}\\.[0-9]{{2}}$') THEN replace(t, '.', '-') END AS DATE) AS flexible FROM n""",
)
def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt_parse_korean, dt_epoch_to_null, dt_parse_flexible."""
    t = F.col("t")
    return made(spark, sf_dir, t=DATE).select("id", dates.korean_date(t).alias("iso"), dates.epoch_to_null(t).alias("no_epoch"), dates.flexible_timestamp(t).cast("date").alias("flexible"))


@query(
    "yearly_windows",
    """WITH b AS (SELECT min(l_shipdate)::DATE AS lo, max(l_shipdate)::DATE AS hi FROM lineitem)
SELECT i::INTEGER AS window_no, (lo + to_years(i::INTEGER))::DATE AS window_start, least((lo + to_years(i::INTEGER + 1))::DATE - 1, hi) AS window_end FROM b, range(0, 100) t(i) WHERE (lo + to_years(i::INTEGER))::DATE <= hi""",
)
def yearly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt_windows: the years from the first shipment to the last."""
    first, last = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).agg(F.min("day"), F.max("day")).first()
    return dates.yearly_windows(spark, str(first), str(last))


@query(
    "hash_ids",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS room, l_quantity * 3 AS area FROM lineitem)
SELECT l_orderkey, l_linenumber, 'space_' || substring(md5(CAST(l_orderkey AS VARCHAR) || '_' || coalesce(room, 'None') || '_' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(CAST(area AS BIGINT) AS VARCHAR) || '.0'), 1, 12) AS unit_id,
  substring(md5('addr ' || CAST(l_orderkey AS VARCHAR)), 1, 16) AS address_id,
  'n_' || substring(sha256(CASE WHEN room IS NULL THEN CAST(l_orderkey AS VARCHAR) ELSE room || '|' || CAST(l_orderkey AS VARCHAR) END), 1, 16) AS notice_id FROM t""",
)
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_unit_id, hash_address_id, hash_crawler_id."""
    room = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise(F.col("l_returnflag"))
    key = F.col("l_orderkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", hashing.unit_id(key, room, F.col("l_linenumber"), F.col("l_quantity") * 3).alias("unit_id"),
        hashing.address_id(F.concat(F.lit("addr "), key)).alias("address_id"), hashing.joined_id("n_", 16, room, key).alias("notice_id"),
    )


ADDRESS = f"""CASE {K} % 7 WHEN 0 THEN concat('서울특별시 은평구 통일로', {S}, ' 갈현동 391-46') WHEN 1 THEN concat('서울 중구 충무로4가 ', {S}, '-3 (초동, 하늘 빌라)') WHEN 2 THEN concat('서울 종로구 나길 ', {S}, ' 2층')
 WHEN 3 THEN concat('서울 강동구 길동 ', {S}, '-7 [별관]') WHEN 4 THEN '서울 노원구 상계동' WHEN 5 THEN '' ELSE NULL END"""


@query(
    "address_text",
    f"""WITH t AS ({made_sql(t=ADDRESS)}), c AS (SELECT *, regexp_replace(t, '\\([^)]*\\)', '', 'g') AS c FROM t)
SELECT id, nullif(string_split_regex(trim(t), '\\s+')[1], '') AS province, string_split_regex(trim(t), '\\s+')[2] AS district,
  CASE WHEN coalesce(t = '', true) THEN 'unknown' WHEN regexp_matches(t, '[가-힣]+동\\s+\\d+[-\\d]*') THEN 'jibun' WHEN regexp_matches(t, '[가-힣]+(?:로|길|대로|가)\\d*[가-힣]*\\s+\\d+[-\\d]*') THEN 'road'
    WHEN regexp_matches(t, '[가-힣]+\\s+[가-힣]+\\s+[가-힣]+동(?:\\s|$)') THEN 'general' ELSE 'unknown' END AS kind,
  regexp_extract(t, '[가-힣0-9]+\\s+(\\d+)(?:-(\\d+))?', 1) AS lot_main, regexp_extract(t, '[가-힣0-9]+\\s+(\\d+)(?:-(\\d+))?', 2) AS lot_sub,
  regexp_replace(trim(regexp_extract(t, '\\([^,]+,\\s*([^)]+)\\)', 1)), '\\s+(주택|빌라|아파트|오피스텔|건물)$', '') AS building,
  trim(regexp_replace(CASE WHEN t IS NULL THEN NULL ELSE coalesce(nullif(regexp_extract(c, '^(.*?(?:[로길][0-9]+(?:-[0-9]+)?(?:\\s|$)|(?:로|길|동|리|[0-9]가)\\s+[0-9]+(?:-[0-9]+)?))', 1), ''), nullif(regexp_extract(c, '^([^0-9]*[0-9]+(?:-[0-9]+)?)', 1), ''), c) END, '\\s+', ' ', 'g')) AS geocodable FROM c""",
)
def address_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_addr_split3, str_addr_type, str_jibun_numbers, str_building_name, str_addr_preprocess (geocoder)."""
    t = F.col("t")
    parts, lot = address.split3(t), address.lot_numbers(t)
    return made(spark, sf_dir, t=ADDRESS).select(
        "id", parts["province"].alias("province"), parts["district"].alias("district"), address.kind(t, general=True).alias("kind"), lot["main"].alias("lot_main"), lot["sub"].alias("lot_sub"),
        address.building_name(t).alias("building"), address.geocodable(t).alias("geocodable"),
    )


BARE = "trim(regexp_replace(regexp_replace({x}, '[0-9]+[-0-9]*', '', 'g'), '\\s+', ' ', 'g'))"
LOT_SQL, ROAD_SQL = "regexp_matches({x}, '[가-힣]동\\s+[0-9]')", "regexp_matches({x}, '[가-힣](?:로|길|대로|가)[0-9]*[가-힣]*\\s+[0-9]')"


@query(
    "address_cleaned",
    f"""WITH t AS ({made_sql(t=ADDRESS)}), h AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(t, '\\([^)]*\\)', ' ', 'g'), '\\[[^\\]]*\\]\\s*$', '')), '\\s+([0-9]+\\s?층|전층|[가-힣]+(생활|빌)).*$', ''), '\\s+', ' ', 'g')) AS housing FROM t),
c AS (SELECT *, [nullif(housing, ''), t, CASE WHEN housing <> '' AND NOT {LOT_SQL.format(x='housing')} AND {ROAD_SQL.format(x='housing')} THEN {BARE.format(x='housing')} END,
  CASE WHEN t <> '' AND ({LOT_SQL.format(x='t')} OR NOT {ROAD_SQL.format(x='t')}) THEN {BARE.format(x='t')} END] AS c FROM h)
SELECT id, housing, trim(regexp_replace(regexp_replace(t, '\\s[가-힣]+역\\([^)]*\\)', '', 'g'), '\\s*\\([^)]*\\)', '', 'g')) AS subway, trim(regexp_replace(regexp_replace(t, '\\([^)]*동[^)]*\\)', '', 'g'), '\\s[가-힣]*공원[가-힣]*', '', 'g')) AS park,
  array_to_string(list_filter(c, lambda x, i: x IS NOT NULL AND list_position(c, x) = i), ' > ') AS candidates, coalesce(regexp_matches(t, '자격|대상|소득|무주택|신청|만\\s*[0-9]+세'), false) AS is_eligibility FROM c""",
)
def address_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_addr_preprocess (housing, subway, park), str_addr_candidates, page_sanity_address; held against fixed cases in the tests."""
    t = F.col("t")
    housing = address.housing(t)
    return made(spark, sf_dir, t=ADDRESS).select(
        "id", housing.alias("housing"), address.subway(t).alias("subway"), address.park(t).alias("park"), F.array_join(address.candidates(t, housing), " > ").alias("candidates"),
        address.looks_like_eligibility(t).alias("is_eligibility"),
    )


PHONE = f"CASE {K} % 6 WHEN 0 THEN '02-123-4567' WHEN 1 THEN '(02) 1234 5678' WHEN 2 THEN concat('010-1234-', lpad({S}, 4, '0')) WHEN 3 THEN '12345' WHEN 4 THEN '1588-1234' ELSE NULL END"
URL = f"CASE {K} % 5 WHEN 0 THEN 'www.example.org/a' WHEN 1 THEN 'https://example.org' WHEN 2 THEN 'no url here' WHEN 3 THEN '' ELSE NULL END"


@query(
    "phone_url",
    f"""WITH t AS ({made_sql(p=PHONE, u=URL)}), n AS (SELECT *, regexp_replace(p, '[^0-9]', '', 'g') AS d FROM t)
SELECT id, CASE WHEN length(d) < 7 THEN NULL WHEN starts_with(d, '02') AND length(d) IN (9, 10) THEN '02-' || substring(d, 3, length(d) - 6) || '-' || right(d, 4)
   WHEN length(d) IN (10, 11) THEN substring(d, 1, 3) || '-' || substring(d, 4, 4) || '-' || substring(d, 8) ELSE d END AS phone,
  CASE WHEN trim(u) = '' OR (contains(trim(u), ' ') AND NOT starts_with(trim(u), 'http')) THEN NULL WHEN starts_with(trim(u), 'http') THEN trim(u) WHEN u IS NULL THEN NULL ELSE 'https://' || trim(u) END AS url,
  coalesce(length(trim(p)) > 2 AND NOT regexp_matches(trim(p), '^[0-9]+$'), false) AS is_meaningful FROM n""",
)
def phone_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_phone, str_url, str_is_meaningful."""
    return made(spark, sf_dir, p=PHONE, u=URL).select("id", T.phone(F.col("p")).alias("phone"), T.url(F.col("u")).alias("url"), T.is_meaningful(F.col("p")).alias("is_meaningful"))


CODE = f"CASE {K} % 5 WHEN 0 THEN 'col' WHEN 1 THEN 'park' WHEN 2 THEN 'hos' WHEN 3 THEN 'zz' ELSE NULL END"
LABEL = f"CASE {K} % 4 WHEN 0 THEN '아파트(공공)' WHEN 1 THEN 'Studio (S)' WHEN 2 THEN '오피스텔' ELSE 'loft' END"


@query(
    "code_label",
    f"""SELECT id, CASE c WHEN 'child' THEN '어린이집' WHEN 'col' THEN '대학교' WHEN 'park' THEN '공원' WHEN 'hos' THEN '병원' ELSE c END AS label,
  CASE WHEN trim(regexp_extract(l, '^([^(]*)\\(', 1)) <> '' THEN trim(regexp_extract(l, '^([^(]*)\\(', 1)) WHEN regexp_matches(l, '[가-힣]') THEN l END AS korean_name,
  CASE c WHEN 'col' THEN 'college' ELSE 'misc' END AS mapped FROM ({made_sql(c=CODE, l=LABEL)})""",
)
def code_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_code_label, str_bt_korean_name, conv_enum_maps, map_symmetry."""
    back = codes.inverse({"college": "col"})
    return made(spark, sf_dir, c=CODE, l=LABEL).select(
        "id", codes.label(F.col("c"), codes.FACILITIES).alias("label"), codes.korean_name(F.col("l")).alias("korean_name"), codes.lookup(F.col("c"), back, "misc").alias("mapped")
    )


@query(
    "json_values",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NULL AS no_props, coalesce(CAST(props AS VARCHAR), '{}') AS props_or_empty FROM events""",
)
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """json_get_text, json_default."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("props").isNull().alias("no_props"), F.coalesce("props", F.lit("{}")).alias("props_or_empty"))


@query(
    "keyword_tokens",
    """WITH w AS (SELECT doc_id, length(text) AS n, list_filter(regexp_extract_all(lower(text), '[가-힣a-zA-Z0-9]+'), lambda x: length(x) >= 2) AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM w""",
)
def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_keyword_tokens over whole documents."""
    t = F.col("t")
    held = table(spark, sf_dir, "documents").select("doc_id", T.keyword_tokens(F.col("text")).alias("t"))
    return held.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query(
    "sql_extracted",
    f"""SELECT id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(t, '(?is)(\\bselect\\b.*)$', 1), '(?s)```.*$', ''), ';\\s*$', '')), '') AS statement
FROM ({made_sql(t=f"CASE {K} % 3 WHEN 0 THEN concat('Here: ```sql SELECT ', {S}, ' FROM t;') WHEN 1 THEN 'no query' ELSE concat('select a from b where c = ', {S}) END")})""",
)
def sql_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str_extract_sql."""
    t = f"CASE {K} % 3 WHEN 0 THEN concat('Here: ```sql SELECT ', {S}, ' FROM t;') WHEN 1 THEN 'no query' ELSE concat('select a from b where c = ', {S}) END"
    return made(spark, sf_dir, t=t).select("id", T.select_statement(F.col("t")).alias("statement"))
