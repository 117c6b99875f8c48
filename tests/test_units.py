"""Operators on small fixed cases."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import address, casts, dates, geo, money
from lodestrata.functions import text as T
from lodestrata.functions.vectors import cosine, cosine_or_zero, pooled, unit
from lodestrata.operators import augment, chunks, containment, conversations, dedupe, evaluate, layout, lookup, pages, rerank, search, spatial, sqlguard, upsert
from lodestrata.sources import files, paged, sinks
from lodestrata.streaming import incremental


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r["out"] for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]

    return run


def test_money(apply):
    assert apply(money.krw_amount, "5500만원", "1억원", "1억 5000만원", "15,000,000원", "문의", "0원", "", None) == [55_000_000, 100_000_000, 10_000, 15_000_000, None, 0, None, None]
    assert apply(lambda c: money.krw_amount(c, fixed=True), "1억 5000만원", "5500만원") == [150_000_000, 55_000_000]
    assert apply(money.area_range, 60.0, 60.01, 85.0, 102.0, 135.0, 135.01, 0.0, None, kind="double") == ["~60이하", "60초과~85이하", "60초과~85이하", "85초과~102이하", "102초과~135이하", "135초과~", "~60이하", None]
    assert apply(lambda c: money.fix_anomaly(c, "deposit"), 99_999, 100_000, -5, 0, None, kind="long") == [999_990_000, 100_000, -50_000, None, None]
    assert apply(lambda c: money.normalised(c, F.lit(0.0), F.lit(0.0)), 1.0, kind="double") == [0.5]


def test_casts_and_dates(apply):
    assert apply(casts.safe_int, "12.5", "-3.9", "nan", "", "x", None) == [12, -3, None, None, None, None]
    assert apply(dates.korean_date, "2024.1.5", "2024년 11월 2일", "2023/07/09", "19.1.1", None) == ["2024-01-05", "2024-11-02", "2023-07-09", None, None]
    assert [str(x) for x in apply(lambda c: dates.flexible_timestamp(c).cast("date"), "2024-02-03T04:05:06Z", "2024.02.03", "20240203", "soon")] == ["2024-02-03"] * 3 + ["None"]


def test_text(apply):
    assert apply(T.clean_ocr, "5000만원   납부\x07\n\n\n\n끝!!!!", None) == ["50만원 납부\n\n끝!", None]
    assert apply(lambda c: T.clean_ocr(c, fixed=True), "5000만원 가능 합니다") == ["5000만원 가능 합니다"]
    assert apply(T.without_headers, "서울시\n12\n본문입니다\nab\n- \n") == ["본문입니다\n- \n"]
    assert apply(T.with_bullets, "  ▪항목\n—대시\n1) 하나") == ["  • 항목\n- 대시\n1)하나"]
    assert apply(T.sentences, "하나입니다. 둘입니다! Three? four") == [["하나입니다.", "둘입니다!", "Three? four"]]
    assert apply(lambda c: T.squeezed(c, join_letters=True), "a b c .") == ["ab c."]
    assert apply(T.phone, "02-123-4567", "(02) 1234 5678", "010-1234-5678", "12345", None) == ["02-123-4567", "02-1234-5678", "010-1234-5678", None, None]
    assert apply(T.short_title, "안녕하세요. 전세 대출 안내", "**버팀목** (2024) 대출") == ["전세 대출 안내", "버팀목 대출"]
    assert apply(T.cut_title, "버팀목 전세자금 대출 신청 절차와 필요한 서류를 안내합니다") == ["버팀목 전세자금 대출 신청 절차와 필요한"]
    assert apply(T.fallback_title, "짧은 문장. 다음", "one two three four five six seven eight") == ["짧은 문장", "one two three four five"]
    assert apply(T.paragraph_type, "| a | b |\n|---|---|\n| 1 | 2 |", "신청 방법:", "• 하나\n• 둘\n이것은 목록의 마지막 줄이며 서른 글자를 넘는 긴 문장입니다", "가" * 40) == ["table", "title", "list", "paragraph"]
    assert apply(T.title_level, "1. 개요", "1.2. 상세", "1.2.3. 더", "신청 안내:", "본문") == [1, 2, 3, 1, 0]
    assert apply(T.numbered_answers, "Q1. 자격이 되나요 네 가능합니다. Q2. ") == [["**Q1.**", "**답변:** 자격이 되나요 네 가능합니다."]]
    assert apply(T.fitted, "가나다라마바사. " * 100)[0][0].startswith("가나다라마바사.") and all(len(p) <= 900 for p in apply(T.fitted, "가나다라마바사. " * 100)[0])
    assert apply(T.keyword_list, "청년, 월세 ,a, Re-nt") == [["청년", "월세", "rent"]]
    assert apply(T.select_statement, "```sql\nSELECT 1;\n```", "no") == ["SELECT 1", None]


def test_markdown_table(spark):
    rows = spark.createDataFrame([([["이름", None], ["", ""], ["a", "b"]],)], "v array<array<string>>")
    assert rows.select(T.markdown_table(F.col("v")).alias("m")).first()["m"] == "| 이름 |  |\n|---|---|\n| a | b |"


def test_address(apply):
    assert apply(address.housing, "서울 종로구 나길 3 2층 (하늘)", "서울 강동구 길동 1-7 [별관]") == ["서울 종로구 나길 3", "서울 강동구 길동 1-7"]
    assert apply(address.geocodable, "서울특별시 은평구 통일로915 갈현동 391-46", "남부순환로105나길 24 가동", "경인로33마길4-7 101호") == ["서울특별시 은평구 통일로915", "남부순환로105나길 24", "경인로33마길4-7"]
    assert apply(address.geocodable, "서울 영등포구 경인로 12 구로동 3-4", "주식회사 하늘 서울 중구 을지로 지하 5", "서울 성동구 성수동2가 300-1 2층", "부산 해운대 12-3번지 근처", "이름뿐", "", None) == [
        "서울 영등포구 경인로 12", "하늘 서울 중구 을지로 지하 5", "서울 성동구 성수동2가 300-1", "부산 해운대 12-3", "이름뿐", "", None,
    ]
    assert apply(address.kind, "서울 은평구 통일로915 갈현동 391-46", "서울 중구 충무로4가 5", "서울 중구 을지로 지하12", "서울 노원구", "") == ["jibun", "road", "road", "jibun", "unknown"]
    assert apply(lambda c: address.kind(c, True), "서울 노원구 상계동", "서울 노원구", None) == ["general", "unknown", "unknown"]
    assert [tuple(r) for r in apply(address.lot_numbers, "서울 은평구 통일로915 갈현동 391-46", "서울 강동구 길동 7", "서울")] == [("391", "46"), ("7", ""), ("", "")]
    assert apply(address.housing, "서울 종로구 나길 3 1 ~ 2 층 전체", "서울 종로구 나길 3 하늘생활주택 3호", "전층 나길 3", None) == ["서울 종로구 나길 3", "서울 종로구 나길 3", "전층 나길 3", None]
    assert apply(address.building_name, "서울 회기로12나길 18 (회기동, 소리소문 주택)") == ["소리소문"]
    assert apply(lambda c: address.candidates(c, address.housing(c)), "서울 강동구 길동 12-7 (별관)") == [["서울 강동구 길동 12-7", "서울 강동구 길동 12-7 (별관)", "서울 강동구 길동 (별관)"]]
    assert apply(lambda c: address.bus_point(c, F.lit("37.5")), "126.9", "x") == ["126.9,37.5", ""]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(cosine(F.col("a"), F.col("b")).alias("c"), cosine_or_zero(F.col("a"), F.col("b")).alias("z"), unit(F.col("b")).alias("u")).collect()
    assert [r["c"] for r in got] == [1.0, -1.0, None, None] and [r["z"] for r in got] == [1.0, -1.0, 0.0, 0.0]
    t = spark.createDataFrame([([[3.0, 4.0], [0.0, 9.0], [5.0, 5.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    p = t.select(pooled(F.col("t"), F.col("m")).alias("mean"), pooled(F.col("t"), F.col("m"), "cls").alias("cls"), pooled(F.col("t"), F.col("m"), "max").alias("max")).first()
    assert p["cls"] == [0.6, 0.8] and [round(x, 6) for x in p["max"]] == [0.316228, 0.948683] and [round(x, 6) for x in p["mean"]] == [0.224860, 0.974391]


def test_radius_bounds(spark):
    """Distances 499.6 to 1000.1: whole metres decide the summary, exact ones the detail."""
    step = lambda m: 126.98 + m / geo.RADIUS * 180 / 3.141592653589793
    home = spark.createDataFrame([("h", "t", 37.56, 126.98)], "notice_id string, title string, lat double, lon double")
    places = [("c1", "col", 499.6), ("c2", "col", 500.3), ("c3", "col", 999.9), ("c4", "col", 1000.1), ("p1", "park", 499.6), ("p2", "park", 500.3), ("n", "park", None)]
    f = spark.createDataFrame([(i, i, cd, 37.56 if m else None, step(m) if m else None) for i, cd, m in places], "facility_id string, name string, cd string, lat double, lon double")
    t = spark.createDataFrame([], "id string, transport_type string, name string, is_transfer boolean, lat double, lon double")
    cached = spatial.distances(home, f)
    assert {r["facility_id"]: r["distance_m"] for r in cached.collect()} == {"c1": 500, "c2": 500, "c3": 1000, "p1": 500}
    assert spatial.summary(home, f, t, cached).first()["infra_score"] == 6
    assert {r["facility_id"] for r in spatial.detail(home, f, t).collect()} == {"c1", "p1"}


def test_lookup(spark):
    master = spark.createDataFrame([(1, "서울 종로구", "a"), (2, "서울 중구", "b"), (3, "서울 종로구", "c")], "line_no int, name string, code string")
    rows = spark.createDataFrame([("서울 종로구",), ("서울종로구",), ("서울 중구 명동",), ("부산",), (None,)], "n string")
    got = {r["n"]: (r["code"], r["stage"]) for r in lookup.staged_lookup(rows, "n", master).collect()}
    assert got == {"서울 종로구": ("c", "exact"), "서울종로구": ("c", "no_blanks"), "서울 중구 명동": ("b", "contains"), "부산": (None, None), None: (None, None)}


def test_upsert_and_dedupe(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "m", 1)], "k int, v string, seq int")
    assert sorted(((r["k"] or 0), r["v"]) for r in upsert.merge(t, s, ["k"], "seq").collect()) == [(0, "m"), (0, "n"), (1, "a"), (2, "d"), (3, "e")]
    assert sorted(((r["k"] or 0), r["v"]) for r in upsert.insert_ignore(t.where("k IS NOT NULL"), s.where("k IS NOT NULL"), ["k"], ["seq"]).collect()) == [(1, "a"), (2, "b"), (3, "e")]
    d = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, pos int")
    assert dedupe.first_rows(d, ["k"], ["pos"]).count() == 2 and dedupe.duplicates(d, ["k"], ["pos"]).first()["pos"] == 2


def test_rerank_fixture(spark):
    rows = [(1, "q", "월세 지원 안내", 0.85, 0, 0), (1, "q", "전세 대출 월세", 0.75, 5, 1), (1, "q", "다른 내용", 0.80, 2, 2)]
    c = spark.createDataFrame(rows, "query_id int, query string, content string, similarity double, chunk_index int, prior_rank int").withColumn("query", F.lit("전세 대출"))
    got = rerank.ranked(rerank.by_keywords(c)).orderBy("rank").collect()
    assert [r["prior_rank"] for r in got] == [1, 0, 2] and round(got[0]["rerank_score"], 6) == round(0.7 * 0.75 + 0.3, 6)
    assert [r["final_rerank_score"] for r in rerank.combined(c).orderBy("prior_rank").collect()] == [0.85, 0.75, 0.80]
    assert [round(r["position_score"], 6) for r in rerank.by_position(c).orderBy("prior_rank").collect()] == [1.0, round(1 / 1.5, 6), round(1 / 1.2, 6)]
    e = c.withColumn("query_embedding", F.array(F.lit(1.0), F.lit(0.0))).withColumn("content_embedding", F.when(F.col("prior_rank") > 0, F.array(F.lit(1.0), F.lit(0.0))))
    assert [round(r["rerank_score"], 6) for r in rerank.by_meaning(e).orderBy("prior_rank").collect()] == [0.85, 0.85, 0.88]


def test_context(spark):
    docs = spark.createDataFrame([(1, "가 나", 0.9, 0, "s1"), (1, "다", 0.8, 1, None)], "query_id int, content string, similarity double, prior_rank int, source string")
    queries = spark.createDataFrame([(1, "질문?"), (2, "없음")], "query_id int, query string")
    top = augment.selected(docs)
    out = {name: {r["query_id"]: r["context"] for r in f(top, queries).collect()} for name, f in augment.LAYOUTS.items()}
    assert out["general"][1] == "질문: 질문?\n\n관련 문서들:\n\n[문서 1] (유사도: 0.900)\n가 나\n\n출처: s1\n\n[문서 2] (유사도: 0.800)\n다\n" and out["general"][2] == augment.NOTHING
    assert out["structured"][1].splitlines()[5:7] == ["Content: 가 나", "Relevance Score: 0.9000"] and out["structured"][2].endswith("None found")
    assert out["markdown"][1].startswith("# 질문\n질문?\n\n## 관련 문서\n### 문서 1 (관련도: 0.900)\n**출처:** s1\n\n가나.")
    assert "[🔥 매우 관련성 높음] 문서 1 (출처: s1)" in out["enhanced"][1] and "출처 미상" in out["enhanced"][1] and "신뢰도: 90.0%" in out["conversational"][1]
    assert out["json"][2] == '{"query":"없음","documents":[]}' and out["prompt"][2].endswith(augment.NOTHING)
    p = spark.createDataFrame([(1, "금리 연 2.5% 입니다. 한도 2억 원. 신청 방법 온라인", 0.8, 0, "s")], docs.schema)
    assert "**금리:** 연 2.5%" in augment.policy(augment.selected(p), queries).where("query_id = 1").first()["context"]


def test_budget_bounds(spark):
    docs = spark.createDataFrame([(q, "w " * n, 1 - i / 10, i) for q, ns in ((1, [50, 50]), (2, [0 + 10, 200]), (3, [9, 200])) for i, n in enumerate(ns)], "query_id int, content string, similarity double, prior_rank int")
    got = {(r["query_id"], r["rank"]): r["n_words"] for r in augment.selected(docs, budget=110).collect()}
    assert got == {(1, 1): 50, (1, 2): 50, (2, 1): 10, (3, 1): 9, (3, 2): 101}


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "x", 0.5), (1, 2, "Cat dog", 0.4), (2, 1, "none", 0.3)], "query_id int, rank int, content string, similarity double")
    queries = spark.createDataFrame([(1, ["cat", "dog"]), (2, ["bird"]), (3, ["bird"]), (4, [])], "query_id int, expected array<string>")
    got = {r["query_id"]: r for r in evaluate.per_query(results, queries).collect()}
    assert set(got) == {1, 2, 3} and got[1]["precision_3"] == 1.0 and got[1]["recall_3"] == 1.0 and got[1]["mrr"] == 0.5 and got[3]["mrr"] == 0.0
    assert round(got[1]["ndcg_3"], 6) == round((1 / 1.5849625007211562) / (1 + 1 / 1.5849625007211562), 6)
    one = evaluate.latency(spark.createDataFrame([(5.0,)], "v double"), "v").first()
    assert one["stddev_ms"] == 0.0 and one["p99_ms"] == 5.0
    u = spark.createDataFrame([(1, 1, "서울시 금리 2%", 0.5)], results.schema)
    total = evaluate.understanding(u, spark.createDataFrame([(1, "금리", ["금리"])], "query_id int, query string, expected array<string>")).first()
    assert total["entity_recognition"] == 1.0 and total["overall_score"] == round(0.25 + 0.2 * 0.8 + 0.2 * 2 / 15 + 0.15 + 0 + 0.05 * 0.5, 6)


def test_chunks():
    assert chunks.windows("a" * 10, 20) == ["a" * 10]
    cut = chunks.windows("a" * 14 + "." + "b" * 20, 20, 5)
    assert cut[0] == "a" * 14 + "." and cut[1].startswith("aaaa.") and "".join(cut).endswith("b")
    assert chunks.by_sentences("") == [] and chunks.by_sentences("short") == ["short"]
    whole = " ".join(f"Sentence number {i} is here." for i in range(60))
    found = chunks.by_sentences(whole)
    assert all(len(c) <= 600 for c in found) and found[1].startswith(found[0][-50:].strip()[:20])
    assert [len(c) for c in chunks.by_sentences("x" * 1001)] == [500, 500, 1]
    table = "| h |\n|---|\n" + "\n".join(f"| row {i} |" for i in range(150))
    parts = chunks.table_rows(table)
    assert len(parts) > 1 and all(p.startswith("| h |\n|---|\n") for p in parts)
    assert chunks.table_rows("| h |") == ["| h |"]


@pytest.mark.parametrize("n", [1, 10, 11, 25])
def test_conversations(spark, n):
    m = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, n + 1)], "conv_id int, turn int, role string, text string")
    old = conversations.batches(m).orderBy("batch_no").collect()
    assert [r["n_messages"] for r in old] == ([] if n <= 10 else [1] if n == 11 else [10, 5])
    recent = [r["turn"] for r in conversations.recent(m).orderBy("turn").collect()]
    assert recent == list(range(max(1, n - 9) if n > 10 else 1, n))


def test_pages(spark, apply):
    html = "<html><head><title>하늘집 | 포털</title></head><body><nav>x</nav><table><tr><th>주소</th><td>서울 은평구 <b>갈현동</b> 1-2</td></tr></table>최종수정일 : 2024.03.05 도보 5분 2호선 홍대입구역 도보 7분 월세 350,000원 주차 <a href='/f/a.pdf'>f</a></body></html>"
    one = spark.createDataFrame([(1, "https://e.org/x", html)], "page_id int, url string, html string")
    text = pages.plain(F.col("html"))
    r = one.select(
        pages.house_name(pages.title(F.col("html")), F.col("url")).alias("name"), pages.last_modified(text).alias("day"), pages.label_value(F.col("html"), ["소재지", "주소"]).alias("address"), pages.pairs(F.col("html")).alias("pairs"),
        pages.stations(pages.subway(text)).alias("subway"), pages.details(text).alias("d"), pages.attachments(F.col("html"), F.col("url")).alias("files"),
    ).first()
    assert r["name"] == "하늘집" and r["day"] == "2024-03-05" and r["address"] == "서울 은평구 갈현동 1-2" and r["pairs"] == {"주소": "서울 은평구 갈현동 1-2"}
    assert r["subway"] == "2호선 홍대입구역 도보 7분" and r["d"]["amenities"] == ["parking"] and r["d"]["money"] == ["350,000원"] and r["files"][0]["url"] == "https://e.org/f/a.pdf"
    assert apply(pages.building_form, "신축 다세대주택 3층", "원룸 (오픈형) 안내", "x" * 60) == ["다세대주택", "원룸 (오픈형)", "x" * 50]
    table = spark.createDataFrame([(1, "<table><tr><th>h</th></tr><tr><td>101</td><td>가능</td></tr><tr><td>102</td><td>불가능</td></tr><tr><td>103</td><td></td></tr></table>")], "page_id int, html string")
    assert [x["available"] for x in pages.occupancy(table).orderBy("row_no").collect()] == [1, 0, 0] and [x["available"] for x in pages.occupancy(table, fixed=False).orderBy("row_no").collect()] == [1, 1, 0]
    u = pages.units(spark.createDataFrame([("n", [30.5, 20.0], [50_000, 5_000_000, 300_000])], "notice_id string, areas array<double>, prices array<bigint>")).orderBy("unit_no").collect()
    assert [(x["area_m2"], x["deposit"], x["rent"], x["fee"]) for x in u] == [(30.5, 5_000_000, 300_000, 50_000), (20.0, 5_000_000, 300_000, 50_000)]


def test_layout(spark):
    rows = [("f", 1, i, t, float(x), float(y), float(y), s, b, w) for i, (t, x, y, s, b, w) in enumerate([("b", 20, 10, 9.0, 1, 0.0), ("a", 10, 12, 9.0, 1, 0.0), ("c", 10, 20, 9.0, 0, 0.0), ("d", 10, 26, 5.0, 0, 0.0), ("e", 30, 21, 9.0, 0, 0.99), (" ", 5, 20, 9.0, 0, 0.0)])]
    chars = spark.createDataFrame(rows, "file string, page int, seq int, text string, x double, y double, top double, size double, bold int, shade double")
    lines = layout.lines(layout.visible(chars)).orderBy("line_no").collect()
    assert [(r["text"], r["is_bold"]) for r in lines] == [("ab", True), ("c", False)]
    box = spark.createDataFrame([("f", 1, 0.0, 0.0, 15.0, 15.0)], "file string, page int, x0 double, top0 double, x1 double, bottom1 double")
    assert layout.outside(chars, box).count() == 5
    s = spark.createDataFrame([("f", 1, "t", "long " * 40), ("f", 2, "t", "long " * 40), ("f", 3, "u", "tiny"), ("f", 4, "v", "long " * 40)], "file string, no int, title string, content string")
    assert layout.grouped_sections(s).count() == 2


def test_guard(spark):
    spark.range(30).createOrReplaceTempView("guarded")
    assert sqlguard.select(spark, "SELECT id FROM guarded;", {"guarded"}).count() == 10
    assert sqlguard.select(spark, "WITH t AS (SELECT id FROM guarded) SELECT count(*) FROM t", {"guarded"}).first()[0] == 30
    for bad in ("DROP TABLE guarded", "SELECT 1; DROP VIEW guarded", "SELECT * FROM other", "SELECT (SELECT max(id) FROM other) FROM guarded", "INSERT INTO guarded VALUES (1)"):
        with pytest.raises(sqlguard.Refused):
            sqlguard.select(spark, bad, {"guarded"})


def fetch(start: int, end: int) -> str:
    rows = "".join(f"<row><a>{i}</a><b>x{i}</b></row>" for i in range(start, min(end, 3) + 1))
    return f"<r><list_total_count>3</list_total_count><RESULT><CODE>INFO-000</CODE></RESULT>{rows}</r>"


def test_paged():
    reader = paged.Reader(__import__("pyspark.sql.types", fromlist=["StructType"]).StructType.fromDDL("a string, b string, c string"), "tests.test_units.fetch", 2)
    parts = reader.partitions()
    assert [(p.start, p.end) for p in parts] == [(1, 2), (3, 3)] and [r for p in parts for r in reader.read(p)] == [("1", "x1", None), ("2", "x2", None), ("3", "x3", None)]
    assert paged.rows_of("<r><RESULT><CODE>ERROR-300</CODE></RESULT><row><a>1</a></row></r>") == []


def test_files(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "a.csv").write_bytes("시군구,층\n서울,3\n".encode("cp949"))
    assert files.probe_encoding(spark, f"{d}/a.csv") == "MS949" and files.csv_any(spark, f"{d}/a.csv", files.RENT_FIELDS).first().asDict() == {"sigungu": "서울", "floor": "3"}
    (tmp_path / "p.csv").write_text("".join(f"note {i}\n" for i in range(15)) + "x,y\n1,a\n2,b\n")
    assert [(r["x"], r["y"]) for r in files.csv_after_preamble(spark, f"{d}/p.csv", "x int, y string").orderBy("line_no").collect()] == [(1, "a"), (2, "b")]
    (tmp_path / "d.tsv").write_text("1\t서울\t존재\n2\t부산\t폐지\n3\t서울\t존재\nbad\n")
    assert [(r["name"], r["code"]) for r in files.dong_codes(spark, f"{d}/d.tsv").collect()] == [("서울", "3")]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = files.json_lines(spark, f"{d}/j.jsonl", "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["raw_data"] for r in bad.collect()] == ["not json"]
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.json_array(spark, f"{d}/a.json", "a int").count() == 2 and files.or_empty(spark, f"{d}/none.json", "a int").count() == 0
    (tmp_path / "q.txt").write_text("# note\n\n전세 대출 | 대출, 한도\n월세\n")
    assert [(r["query"], r["expected"]) for r in files.eval_queries(spark, f"{d}/q.txt").orderBy("line_no").collect()] == [("전세 대출", ["대출", "한도"]), ("월세", [])]
    (tmp_path / "x.xml").write_text("<r><row><a>1</a></row><row><a>2</a></row></r>")
    assert files.xml_rows(spark, f"{d}/x.xml", schema="a int").count() == 2
    for day in ("20240101", "20240301"):
        (tmp_path / f"l_{day}.log").write_text(f"{day}\n")
    assert [r["value"] for r in files.latest_named(spark, f"{d}/l_*.log").collect()] == ["20240301"]
    spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01")], "a int, date string").write.partitionBy("date").parquet(f"{d}/parts")
    assert [r["a"] for r in files.latest(spark.read.parquet(f"{d}/parts")).collect()] == [2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.123456)], "k int, v double")
    assert sinks.json_array_text(df, ["k"]).first()["json"] == '[{"k":1},{"k":2,"v":0.123456}]'
    sinks.write_csv(df, str(tmp_path / "c"))
    assert "0.1235" in "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    for _ in range(2):
        sinks.reload_partitions(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and sinks.merged([df, df.withColumn("w", F.lit(1))]).count() == 4


def test_stream(spark, tmp_path):
    d = str(tmp_path)
    source = lambda: incremental.new_files(spark, f"{d}/in", "k int, v string", "json")
    for n in (1, 2):
        spark.createDataFrame([(n, "a"), (None, "b")], "k int, v string").coalesce(1).write.mode("append").json(f"{d}/in")
        stream = source().withColumn("file", F.lit("f")).withColumn("row", F.lit(0))
        incremental.run_checked(stream, {"k": F.col("k").isNotNull()}, f"{d}/good", f"{d}/bad", f"{d}/state", "file", "row")
        assert spark.read.parquet(f"{d}/good").count() == n and spark.read.parquet(f"{d}/bad").count() == n
    incremental.run_checked(source().withColumn("file", F.lit("f")).withColumn("row", F.lit(0)), {"k": F.col("k").isNotNull()}, f"{d}/good", f"{d}/bad", f"{d}/state", "file", "row")
    assert spark.read.parquet(f"{d}/good").count() == 2


def test_search_logs_and_stats(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "id int, embedding array<float>")
    assert [r["id"] for r in search.top_k(v, [1.0, 0.0], 3, 0.0).collect()] == [1, 2, 4]
    assert search.top_k(v, [0.0, 0.0], 3).count() == 0
    with pytest.raises(ValueError, match="unknown model"):
        search.of_model(v.withColumn("model_name", F.lit("m")), "x", ["m"])


def test_facility_address(apply):
    raw = ["서울 종로구 세종대로 175 세종이야기 지하1층", "서울 강남구 테헤란로 152 강남빌딩 3층", "서울 중구 을지로 12 (을지로1가) 101호", "서울 마포구 독막로 3 나라어린이집", "서울 강서구 화곡로13길5"]
    assert apply(address.facility, *raw) == ["서울 종로구 세종대로 175 세종이야기", "서울 강남구 테헤란로 152", "서울 중구 을지로 12", "서울 마포구 독막로 3", "서울 강서구 화곡로13길 5"]
    more = ["서울 중구 을지로 12 서울 중구 을지로 12", "서울 중구 을지로 12 - ,", "하늘병원", None, "서울 마포구 합정동 3-1 한강 B2"]
    assert apply(address.facility, *more) == ["서울 중구 을지로 12", "서울 중구 을지로 12", "하늘병원", None, "서울 마포구 합정동 3-1 한강"]


def test_faq(apply):
    assert apply(T.faq, "머리 구분답변\n어떻게 신청하나요?\n누리집에서 신청합니다. 네.\n무엇이 필요한가요?\n") == [["**질문:** 어떻게 신청하나요?", "**답변:** 누리집에서 신청합니다."]]
    assert apply(T.faq, "질문내용\n1. 대상은?\n설명", "첫 문단\n둘째 줄\n\n다음") == [["**질문:** 대상은?"], ["첫 문단\n둘째 줄", "다음"]]
    assert apply(T.table_rows, "=== 표 1 ===\n| a | b |\n|---|---|\n| 1 | 두 줄\n이어짐 |\n") == [["| a | b |", "| 1 | 두 줄 이어짐 |"]]
    assert apply(T.is_faq, "Q1. 무엇", "평범한 글") == [True, False]


def test_rag(spark):
    from lodestrata.operators import rag

    texts = ["전세 대출 한도 안내", "월세 지원 신청", "주택 청약 절차", ""]
    chunks = rag.encoded(spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id int, content string, chunk_index int"), "content", rag.hash_encoder(256))
    queries = rag.encoded(spark.createDataFrame([(1, "월세 지원", ["월세"]), (2, "전세 대출", ["대출"])], "query_id int, query string, expected array<string>"), "query", rag.hash_encoder(256), "query_embedding")
    for reranked in (False, True):
        best = {r["query_id"]: r["id"] for r in rag.searched(chunks, queries, 2, reranked=reranked).where("rank = 1").collect()}
        assert best == {1: 1, 2: 0}
    context = {r["query_id"]: r["context"] for r in rag.augmented(rag.searched(chunks, queries, 2), queries).collect()}
    assert "[문서 1] (관련도: " in context[1] and "월세 지원 신청" in context[1]
    row = rag.evaluated({"m": chunks}, queries, 2).first()
    assert row["model_name"] == "m" and row["recall_1"] == 1.0 and row["mrr"] == 1.0 and row["success_rate"] == 1.0
    assert rag.prepared(F.lit("x"), "e5", True) is not None and rag.answered(rag.augmented(rag.searched(chunks, queries, 1), queries), F.length).count() == 2


def test_schemas(spark):
    from lodestrata import schemas
    from lodestrata.operators.upsert import accepted, checked

    assert all(schemas.empty(spark, name).count() == 0 for name in schemas.TABLES)
    users = spark.createDataFrame([(1, "a@b.org", "u", "user"), (2, "bad", "u", "user"), (3, None, "u", None), (4, "c@d.org", "u", "root")], schemas.TABLES["users"])
    assert {r["id"]: r["error"] for r in checked(users, schemas.checks("users")).collect()} == {1: None, 2: "email", 3: None, 4: "role"}
    assert accepted(checked(users, schemas.checks("users"))).count() == 2
    with pytest.raises(ValueError, match="no parent"):
        schemas.enforced(users, "id", users.where("id = 1"), "id", "restrict")
    stamp = spark.sql("SELECT 1 AS id, timestamp'2024-01-01' AS updated_at")
    child = spark.sql("SELECT 1 AS conversation_id, timestamp'2024-02-01' AS created_at")
    assert str(schemas.touched(stamp, "id", child, "conversation_id", "created_at").first()["updated_at"]).startswith("2024-02-01")


def test_containment(spark):
    """All pairs, with parts shorter than a gram, empty and null ones, repeats and signs beyond the plane."""
    rng = random.Random(9)
    letters = "ab가나\U0001f600 "
    make = lambda most: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    wholes, parts = [make(12) for _ in range(150)] + [None, ""], [make(7) for _ in range(150)] + [None, "", "가", "가가"]
    got = containment.containing(spark.createDataFrame([(w,) for w in wholes], "whole string"), spark.createDataFrame([(p,) for p in parts], "part string"))
    assert sorted(map(tuple, got.collect())) == sorted({(w, p) for w in wholes for p in parts if w is not None and p and p in w})
    assert containment.containing(got.select("whole").limit(0), got.select("part")).count() == 0


@pytest.mark.parametrize("blank", [False, True])
def test_contained_code(spark, blank):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("동가구 ") for _ in range(rng.randrange(1, 6)))
    master = [(n, make(), f"c{n}") for n in range(60)] + ([(70, "", "c70")] if blank else [])
    names = sorted({make() for _ in range(80)} | ({""} if blank else set()))
    found = lookup.contained_code(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(master, "line_no int, name string, code string"))
    want = {n: next((c for _, m, c in master if m in n or n in m), None) for n in names}
    assert {r["name"]: r["code"] for r in found.collect()} == {n: c for n, c in want.items() if c}
    plan = lookup.contained_code(spark.range(0).selectExpr("string(id) AS name"), spark.createDataFrame(master, "line_no int, name string, code string"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and not re.search(r"NestedLoopJoin[^\n]*contains", plan)


def test_charset_of_last_lines(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes(b"id,name\n" + b"".join(b"%d,plain\n" % n for n in range(300)) + "301,서울\n".encode("cp949"))
    (tmp_path / "utf.csv").write_bytes(b"id,name\n" + b"x" * 40_000 + ",서울\n".encode())
    assert files.probe_encoding(spark, str(tmp_path / "late.csv")) == "MS949" and files.probe_encoding(spark, str(tmp_path / "utf.csv")) == "UTF-8"
    assert {r["name"] for r in files.csv_any(spark, str(tmp_path / "late.csv")).where("id = 301").collect()} == {"서울"}


def test_lines_of_several_splits(spark, tmp_path):
    """Numbers go on over splits, in each file; lines end in any of three ways."""
    held = {"a.txt": [f"line {n} " + "x" * (n % 97) for n in range(5000)], "b.txt": ["", "", "last"], "c.txt": []}
    for name, lines in held.items():
        (tmp_path / name).write_bytes("".join(x + ("\n", "\r\n")[n % 2] for n, x in enumerate(lines)).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = files.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        got = sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(f, n, x) for f, lines in sorted(held.items()) for n, x in enumerate(lines, 1)]


def test_chunk_ids(spark):
    rows = spark.createDataFrame([(2**60 + 1, "first text."), (None, "second."), (2**60 + 3, "third."), (4, None), (5, " ")], "doc_id long, text string").coalesce(1)
    for way in chunks.WAYS:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["content"]) for r in chunks.chunked(rows, way).collect()) == [(False, 2**60 + 1, "first text."), (False, 2**60 + 3, "third."), (True, 0, "second.")]


def test_numbered(spark):
    """A category over several ranges, equal orders, null categories, and names of the work."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(500), n) for n in range(2000)]
    got = dedupe.numbered(spark.createDataFrame(rows, "category string, no int, part int"), "category", ["no", "part"], "place").collect()
    want, seen = {}, {}
    for c, no, part in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        seen[c] = seen.get(c, 0) + 1
        want[part] = seen[c]
    assert {r["part"]: r["place"] for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("most", [5, 10**6])
def test_dense_cells(spark, most):
    """Nine tenths of the points in one square: all pairs, and no part with more than its share."""
    rng = random.Random(most)
    spot = lambda: (rng.uniform(0, 99), rng.uniform(0, 99)) if rng.random() < 0.9 else (rng.uniform(-500, 500), rng.uniform(-500, 500))
    homes, places = [(i, *spot()) for i in range(200)], [(i, *spot()) for i in range(300)] + [(300, 100.0, 0.0), (301, -100.0, 100.0)]
    h, p = spark.createDataFrame(homes, "h int, x double, y double"), spark.createDataFrame(places, "p int, x double, y double")
    got = sorted((r["h"], r["p"]) for r in spatial.within(h, p, 100.0, most=most).collect())
    assert got == sorted((i, j) for i, a, b in homes for j, c, d in places if ((a - c) ** 2 + (b - d) ** 2) ** 0.5 <= 100)
    fine = p.withColumns({c: F.floor(F.col(v) / (100 / 2**5)) for c, v in (("fx", "x"), ("fy", "y"))})
    found = {(r["bx"], r["by"]): r["level"] for r in spatial.levels(fine, most).collect()}
    parts = {}
    for _, x, y in places:
        level = found[x // 100, y // 100]
        parts[level, x // (100 / 2**level), y // (100 / 2**level)] = parts.get((level, x // (100 / 2**level), y // (100 / 2**level)), 0) + 1
    assert (max(n for (level, _, _), n in parts.items() if level < 5) <= most) and (most > 5 or found[0, 0] > 0)


def test_chunks_by_parts(monkeypatch):
    """A batch leaves in parts of bounded size; ids, nulls and blank texts keep their places."""
    texts = ["One. " * 40, None, "", "  ", "Two sentences. And more. " * 30, "x" * 5000, "Short.", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(chunks, "PART", 300)
    assert list(chunks._parts(pa.array(texts), 300)) == [(0, 4), (4, 5), (5, 6), (6, 8)]
    assert list(chunks._parts(pa.array([], pa.string()), 300)) == []
    out = list(chunks._split(iter([batch, batch.slice(3, 0), batch.slice(4)]), "sentences", {}))
    got = [(i, p) for b in out for i, p in zip(b["doc_id"].to_pylist(), b["pieces"].to_pylist(), strict=True)]
    want = [(i, [c for c in chunks.by_sentences(t) if c.strip()] if t and t.strip() else []) for i, t in enumerate(texts)]
    assert got == want + want[4:]


def test_lines_are_stripped_once(spark):
    """A line's ends are taken off a fixed number of times, however many rules look at it."""
    one = T.with_bullets(T.without_headers(F.col("text")))
    plan = spark.createDataFrame([("a",)], "text string").select(one.alias("out"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") <= 12
    lines = " • one\n  12) two\n\n기간\n\u00a0조건: x \n제12호\n붙임3\n-\u3000three\n77\nab\nABC 특징\n끝:\n12-"
    got = plan and spark.createDataFrame([(lines,), (None,), ("",)], "text string").select(one.alias("out")).collect()
    assert [r["out"] for r in got] == [" • one\n  12)two\n\n • 조건: x\n- three\n• ABC 특징\n12-", None, ""]
