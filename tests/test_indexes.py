"""The inverted indexes of texts and vectors against plain search."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions.vectors import cosine
from lodestrata.operators import encoder, ivf, layout, postings, reach, refresh, search, spatial


@pytest.mark.parametrize("first", [1, 3])
def test_postings(spark, first):
    rng = random.Random(first)
    vocabulary = [f"w{i}" for i in range(40)] + ["서울", "X9"]
    texts = [(i * 3, " ".join(rng.choice(vocabulary[: rng.randrange(3, 42)]) for _ in range(rng.randrange(60)))) for i in range(200)]
    texts += [(601, None), (602, ""), (None, "w1 w2 w3"), (2**60 + 1, "w1 w2"), (2**60 + 3, "w1 w2"), (603, "w39 " * 500)]
    queries = [(1, "w1 w2 W2"), (2, "서울 x9 unknown"), (3, ""), (4, None), (5, "nothing known"), (6, "w39 w0 w5 w7")]
    index = postings.build(spark.createDataFrame(texts, "id long, content string"), block_ids=32)
    got = postings.top_k(index, spark.createDataFrame(queries, "query_id int, query string"), 7, first).collect()

    words = lambda t: [w for w in re.findall("[가-힣a-zA-Z0-9]+", (t or "").lower()) if len(w) >= 2]
    docs = {i: Counter(words(t)) for i, t in texts if i is not None}
    mean, often = sum(sum(c.values()) for c in docs.values()) / len(docs), Counter(t for c in docs.values() for t in c)
    want = []
    for q, text in queries:
        terms = set(words(text)) & set(often)
        most = sum(math.floor(math.log(1 + len(docs) / often[t]) * 1000 * 2.2) for t in terms)
        part = lambda t, c: math.floor(math.log(1 + len(docs) / often[t]) * 1000 * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)))
        scores = sorted(((-sum(part(t, c) for t in terms if t in c), i) for i, c in docs.items() if terms & set(c)))[:7]
        want += [(q, i, -s, -s * 1000 // most / 1000, n) for n, (s, i) in enumerate(scores, 1)]
    assert sorted((r["query_id"], r["id"], r["score"], r["share"], r["rank"]) for r in got) == sorted(want)
    assert postings.top_k(postings.build(spark.createDataFrame([], "id long, content string")), spark.createDataFrame(queries, "query_id int, query string"), 3).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_ivf_recall(spark, kind):
    """At least nine of ten true neighbours, of clustered and of isotropic vectors; what is found is compared exactly."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)) + (rng.normal(size=(30, 16)) * 3)[rng.integers(30, size=1500)] * (kind == "clusters")
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (None, rows[0][1]), (5004, [None] * 16), (5005, rows[0][1])]
    v = spark.createDataFrame(rows + odd, "id long, embedding array<float>")
    index = ivf.build(v, 16)
    asked = [i for i in range(1500) if i % 20 == 0]
    q = v.where("id < 1500 AND id % 20 = 0").selectExpr("id AS query_id", "embedding AS query_embedding")
    got = {}
    for r in ivf.search(index, q).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["similarity"])
    held = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    unit = held / np.linalg.norm(held, axis=1)[:, None]
    right = 0
    for i in asked:
        s = unit @ unit[i]
        true = set(np.argsort(-s, kind="stable")[:5].tolist())
        found = {0 if n == 5005 else n for n, _ in got[i].values()}
        right += len(true & found)
        assert sorted(got[i]) == [1, 2, 3, 4, 5] and all(abs(s[0 if n == 5005 else n] - sim) < 1e-9 for n, sim in got[i].values())
    assert right >= 0.9 * 5 * len(asked)
    if kind == "clusters":
        assert index.model.probes < len(index.model.centroids)
    assert ivf.search(ivf.build(v.limit(0), 16), q).count() == 0


def test_encoder(spark):
    """Neighbours by the encoder against exact tf-idf cosines: texts of one topic are nearest, and the two orders agree."""
    rng = random.Random(8)
    topics = [[f"{t}{i}" for i in range(25)] for t in ("alpha", "beta", "gamma", "delta", "보증")]
    texts = [(n, " ".join(rng.choice(topics[n % 5]) if rng.random() < 0.8 else f"common{rng.randrange(30)}" for _ in range(40))) for n in range(150)] + [(200, None), (201, "a !"), (None, "alpha1 alpha2")]
    docs = spark.createDataFrame(texts, "id long, content string")
    model = encoder.fit(docs, 32)
    got = {r["id"]: np.array(r["embedding"]) for r in encoder.encode(docs, model).collect()}
    again = {r["id"]: np.array(r["embedding"]) for r in encoder.encode(docs, encoder.fit(docs, 32)).collect()}
    assert sorted(got) == sorted(i for i, _ in texts if i is not None) and not got[200].any() and not got[201].any()
    assert all(np.allclose(got[i], again[i]) for i in got)
    words = {i: Counter(re.findall("[가-힣a-zA-Z0-9]{2,}", t.lower())) for i, t in texts if i is not None and i < 150}
    often = Counter(t for c in words.values() for t in c)
    place = {t: n for n, t in enumerate(sorted(often))}
    exact = np.zeros((150, len(place)))
    for i, c in words.items():
        for t, tf in c.items():
            exact[i, place[t]] = (1 + math.log(tf)) * (math.log((1 + 152) / (1 + often[t])) + 1)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    a, b = unit(exact), unit(np.array([got[i] for i in range(150)]))
    a, b = a @ a.T - 2 * np.eye(150), b @ b.T - 2 * np.eye(150)
    same = np.mean([(np.argsort(-b[i])[:10] % 5 == i % 5).mean() for i in range(150)])
    assert same > 0.95 and np.corrcoef(a[np.triu_indices(150, 1)], b[np.triu_indices(150, 1)])[0, 1] > 0.8


def test_grouped_sections(spark):
    """Against the fold over a file's sections, with files of many blocks, null titles and equal titles apart."""
    rng = random.Random(4)
    rows = [(f, n * 3, rng.choice(["a", "b", None]), "x" * rng.choice([3, 3, 120])) for f, most in (("f", 400), ("g", 3), (None, 2)) for n in range(most)]
    want = []
    for f in ("f", "g", None):
        out = []
        for _, no, title, content in sorted(r for r in rows if r[0] == f):
            if out and (len(content) < 100 or title == out[-1][2]):
                out[-1][3] += "\n" + content
            else:
                out.append([f, no, title, content])
        want += [tuple(x) for x in out]
    for block in (20, 10**6):
        got = layout.grouped_sections(spark.createDataFrame(rows, "file string, no int, title string, content string"), block=block)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_table_candidates(spark):
    """Columns by gaps and by aligned words."""
    held = [("k", 0), ("name", 30), ("12", 90), ("a", 0), ("b c", 33), ("7", 90), ("x", 0), ("y", 41), ("9", 90)]
    rows = [("f", 1, n // 3, n, t, float(x), 5.0) for n, (t, x) in enumerate(held)]
    words = spark.createDataFrame(rows, "file string, page int, line_no int, seq int, text string, x double, width double")
    got = {r["strategy"]: r["cells"] for r in layout.table_candidates(words).collect()}
    assert got == {"gaps": [["k", "name", "12"], ["a", "b c", "7"], ["x", "y", "9"]], "aligned": [["k name", "12"], ["a b c", "7"], ["x y", "9"]]}
    (best,) = layout.best_tables(layout.table_candidates(words)).collect()
    assert best["strategy"] == "aligned"  # a greater share of its cells has numbers


def test_refresh(spark, tmp_path):
    """A batch loaded again, and again with other rows, counts once, as it was last."""
    kind = "building_type string, emd_code int, sigungudong string, area_range string, converted_price double, contract_year_month int"
    rows = [("A", i % 2, f"d{i % 2}", "r", i + 0.25, 202001 + i % 5) for i in range(40)] + [("A", 0, "d0", "r", None, 202001), ("A", 0, "d0", "r", 5.0, 190001)]
    path, halves = f"file://{tmp_path}/s", (rows[:20], rows[20:])
    for number in (0, 1, 0, 1):
        refresh.load(spark.createDataFrame(halves[number], kind), number, path, 200001)
    got = sorted((r["emd_code"], r["transaction_count"], r["avg_converted_price"], r["period_start_ym"], r["period_end_ym"]) for r in refresh.statistics(spark, path).collect())
    assert got == [(0, 20, 19.25, 202001, 202005), (1, 20, 20.25, 202001, 202005)]
    refresh.load(spark.createDataFrame(halves[1][:2], kind), 1, path, 200001)
    assert sum(r["transaction_count"] for r in refresh.statistics(spark, path).collect()) == 22


def test_exact_blocks(spark, monkeypatch):
    """Queries beyond a broadcast are dealt to blocks, with the same result."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=6)], i % 2) for i in range(90)]
    v = spark.createDataFrame(rows, "id int, embedding array<float>, label int")
    q = v.where("id < 40").selectExpr("id AS query_id", "embedding AS query_embedding", "label")
    for by in (None, ["label"]):
        asked = q if by else q.drop("label")
        whole = sorted(map(tuple, search.top_k_each(v.drop("label") if not by else v, asked, 4, -1.0, by).collect()))
        monkeypatch.setattr(search, "BROADCAST_QUERIES", 7)
        monkeypatch.setattr(search, "BLOCK_ROWS", 20)
        assert sorted(map(tuple, search.top_k_each(v.drop("label") if not by else v, asked, 4, -1.0, by).collect())) == whole and len(whole) == 160
        monkeypatch.undo()


def test_exact_each(spark):
    """The exact way by products of blocks against cosine() of every pair: copies, odd vectors and lengths, ties; its plan compares no pair by an expression."""
    rng = np.random.default_rng(9)
    whole = [[float(c) for c in rng.normal(size=6)] for _ in range(70)]
    held = whole + [[2 * c for c in whole[3]]] * 4 + [whole[3]] * 8 + [None, [0.0] * 6, [None] * 6, [float("nan")] * 6, [float("inf")] + [1.0] * 5, [1.0, 2.0], [3.0, 1.0], []]
    rows = [(1000 - i * 7, v, i % 3 if i % 11 else None) for i, v in enumerate(held)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, label int")
    q = v.where("id % 2 = 0").selectExpr("id AS query_id", "embedding AS query_embedding", "label")
    for by, floor in (([], -1.0), ([], 0.3), (["label"], -1.0)):
        pairs = v.join(q, by) if by else v.drop("label").crossJoin(q.drop("label"))
        scored = pairs.withColumn("similarity", cosine(F.col("embedding"), F.col("query_embedding"))).where(F.col("similarity") >= floor)
        rank = F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("similarity"), "id"))
        want = scored.withColumn("rank", rank).where("rank <= 5").select("query_id", *by, "id", "similarity", "rank")
        got = search.top_k_each(v if by else v.drop("label"), q if by else q.drop("label"), 5, floor, by)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_postings_of_terms(spark):
    """Postings of the terms that are asked for give the scores of the full index, and scores() those of all documents."""
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(40)))) for i in range(150)] + [(150, None), (151, "!"), (None, "w1")]
    docs = spark.createDataFrame(texts, "id long, content string")
    queries = spark.createDataFrame([(1, "w1 w2 W2"), (2, "w3 unknown"), (3, None), (4, "w1 w29 w7")], "query_id int, query string")
    full, some = postings.build(docs), postings.build(docs, terms=postings.terms_of(queries).select("term"))
    plain = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "share").collect()))
    want = plain(postings.top_k(full, queries, 1000))
    assert plain(postings.top_k(some, queries, 1000)) == want == plain(postings.scores(some, queries)) and len(want) > 150
    assert {r["term"] for r in some.postings.select("term").distinct().collect()} == {"w1", "w2", "w3", "w7", "w29"}


def test_postings_of_shared_ids(spark):
    """Rows of one id are one text, also where they are cut within what is asked for; texts without words count as texts."""
    parts = [(1, "w1 w2"), (1, "w2 x"), (1, None), (2, "w1 y"), (3, ""), (3, "!"), (4, "z z w2"), (None, "w1")]
    whole = [(1, "w1 w2 w2 x"), (2, "w1 y"), (3, "!"), (4, "z z w2")]
    queries = spark.createDataFrame([(1, "w1 w2 q9"), (2, "w2")], "query_id int, query string")
    plain = lambda rows, **o: sorted(map(tuple, postings.scores(postings.build(spark.createDataFrame(rows, "id long, content string"), **o), queries).collect()))
    want = plain(whole)
    assert len(want) == 5 and plain(parts) == want == plain(parts, terms=postings.terms_of(queries).select("term")) == plain(whole, terms=postings.terms_of(queries).select("term"))


def test_postings_move_once(spark, monkeypatch):
    """No step of the index joins postings with lengths by shuffling, nor do the first blocks of a search shuffle them."""
    plans = {}
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path: (plans.update({path.rsplit("/", 1)[1]: self._df._jdf.queryExecution().executedPlan().toString()}), write(self, path))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries = spark.createDataFrame([(1, "w1 w2")], "query_id int, query string")
        index = postings.build(spark.createDataFrame([(i, f"w{i % 4} w1 x") for i in range(20)], "id long, content string"), terms=postings.terms_of(queries).select("term"))
        assert postings.top_k(index, queries, 3).count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {"words", "postings", "first"} <= set(plans)
    shuffled = [name for name, plan in plans.items() if name not in ("wanted", "bounds", "first") and "SortMergeJoin" in plan]
    assert not shuffled and "BroadcastHashJoin [term" in plans["first"], shuffled


def test_encoder_plans(spark, monkeypatch):
    """No plan of the encoder has more expressions than a few a dimension: the Gram matrix and the turn are not spelt out."""
    most = []
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path: (most.append(len(self._df._jdf.queryExecution().optimizedPlan().toString())), write(self, path))[1])
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} w{i}") for i in range(20)], "id long, content string")
    made = encoder.encode(docs, encoder.fit(docs))
    most.append(len(made._jdf.queryExecution().optimizedPlan().toString()))
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(most) > 4 and max(most) < 60_000, most


def test_distances_once(spark):
    """Each pair once, though points repeat; pairs are brought together again only where an id has several points."""
    at = lambda rows, kind: spark.createDataFrame(rows, f"{kind}, lon double, lat double")
    homes = [(i, "t", 127.0 + i * 1e-4, 37.5) for i in range(30)] + [(3, "t", 127.0 + 3e-4, 37.5)]
    places = [(i, "n", "col" if i % 2 else "park", 127.001, 37.5 + i * 1e-4) for i in range(20)]
    plain = lambda more: spatial.distances(at(homes + more, "notice_id int, title string"), at(places, "facility_id int, name string, cd string"))
    one, two = plain([]), plain([(5, "t", 127.0 + 5e-4, 37.5 + 1e-7)])
    aggregates = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    for df in (one, two):
        rows = list(map(tuple, df.collect()))
        assert len(rows) == len(set(rows)) and len({r[:2] for r in rows}) == 600
    assert aggregates(one) < aggregates(two)


def test_pairs_are_spread(spark):
    """Pairs of small tables are made by many tasks, whichever table is larger, and metres are rounded as before."""
    rng = random.Random(5)
    spot = lambda n: [(i, rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(n)]
    few, many = spot(40), spot(700)
    for homes, places in ((few, many), (many, few)):
        h, p = spark.createDataFrame(homes, "h int, x double, y double"), spark.createDataFrame(places, "p int, x double, y double")
        pairs = spatial.within(h, p, 100.0, F.when(F.col("p") % 2 == 0, 100.0).otherwise(50.0), most=20)
        assert pairs.select(F.spark_partition_id().alias("n")).distinct().count() > 8
        got = sorted((r["h"], r["p"]) for r in pairs.collect())
        assert got == sorted((i, j) for i, a, b in homes for j, c, d in places if ((a - c) ** 2 + (b - d) ** 2) ** 0.5 <= (50 if j % 2 else 100))
    edges = spark.createDataFrame([(x,) for x in (0.0, 0.49999999999999994, 0.5, 1.5, 2.5, 500.49999999999994, 500.5, 999.9999999)], "d double")
    assert all(r[0] == r[1] for r in edges.select(spatial.whole(F.col("d")), F.round("d").cast("bigint")).collect())


def test_sums_within_reach():
    """Sums and nearest places of the grid against all pairs: even, dense, repeated, single and no places, points on the circle's edge."""
    rng = np.random.default_rng(7)
    even, dense = rng.uniform(0, 900, (3000, 2)), rng.normal(450, 3, (2000, 2))
    edge = np.array([[500.0, 0.0], [0.0, 500.0], [300.0, 400.0], [500.0000001, 0.0]])
    for places in (even, np.concatenate([even[:50], dense]), np.repeat(even[:20], 2, axis=0), edge, edge[:1], edge[:0]):
        points = np.concatenate([rng.uniform(-400, 1400, (300, 2)), rng.normal(450, 200, (100, 2)), [[0.0, 0.0], [1000.0, 0.0]]])
        weight = rng.integers(1, 4, len(places)).astype(float)
        grid = reach.Grid(places[:, 0], places[:, 1], weight, 500.0)
        d = np.sqrt((points[:, 0, None] - places[:, 0]) ** 2 + (points[:, 1, None] - places[:, 1]) ** 2)
        assert (grid.total(points[:, 0], points[:, 1]) == ((d <= 500) * weight).sum(axis=1)).all()
        least = d.min(axis=1, initial=np.inf)
        assert np.array_equal(grid.nearest(points[:, 0], points[:, 1]), np.where(least <= 500, least, np.nan), equal_nan=True)


def _city(spark, rng, more_homes=(), more_places=()):
    spot = lambda: (126.98 + rng.uniform(0, 0.02), 37.56 + rng.uniform(0, 0.02))
    homes = [(i, f"t{i}", *spot()) for i in range(60)] + [(60, "far", 128.0, 36.0), (61, "none", None, 37.5), (None, "null", *spot()), *more_homes]
    places = [(i, rng.choice([f"n{i % 7}", None]), rng.choice(["col", "park", "hos", "xyz"]), *spot()) for i in range(80)] + [(None, "x", "park", *spot()), *more_places]
    stops = [(i, f"s{i}", rng.choice(["subway", "bus", "ship"]), rng.random() < 0.3, *spot()) for i in range(200)]
    at = "lon double, lat double"
    return spark.createDataFrame(homes, f"notice_id int, title string, {at}"), spark.createDataFrame(places, f"facility_id int, name string, cd string, {at}"), spark.createDataFrame(stops, f"id int, name string, transport_type string, is_transfer boolean, {at}")


@pytest.mark.parametrize("repeated", [False, True])
def test_summary_without_pairs(spark, repeated):
    """Summaries and scores are the same whether distances are handed in or not, with missing ids and names, ids of several points and rows; scores group no pairs."""
    rng = random.Random(11)
    more = [(3, "t3", 126.99, 37.57), (4, "t4", 126.985, 37.565), (4, "t4", 126.985, 37.565)] if repeated else [], [(5, "again", "park", 126.99, 37.57), (6, "n6", "col", 126.985, 37.565)] if repeated else []
    homes, places, stops = _city(spark, rng, *more)
    rows = lambda df: sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in df.collect()), key=str)
    want = rows(spatial.summary(homes, places, stops, spatial.distances(homes, places)))
    assert rows(spatial.summary(homes, places, stops)) == want and any(len(r[2]) == 4 for r in want)
    scored = spatial.scores(homes, places, stops)
    assert rows(scored) == sorted(((r[0], r[-1]) for r in want), key=str)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert repeated or ("SQRT" not in plan and "collect_list" not in plan and "MapInArrow" in plan)


def test_encoder_blocks(spark, tmp_path, monkeypatch):
    """Vectors are moved for the terms of a block, not for those of each text, and blocks change nothing; texts of one id are one text."""
    rng = random.Random(2)
    texts = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(30))) for i in range(300)]
    kind = "id long, content string"
    docs, split = spark.createDataFrame(texts, kind), spark.createDataFrame([(i, part) for i, t in texts for part in (t[: len(t) // 2].rpartition(" ")[0], t[len(t[: len(t) // 2].rpartition(" ")[0]) :])], kind)
    vectors = lambda d: np.array([r["embedding"] for r in sorted(encoder.encode(d, encoder.fit(d, 16)).collect(), key=lambda r: r["id"])])
    monkeypatch.setattr(encoder, "shared_folder", lambda s, name: f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    one = vectors(docs)
    moved = spark.read.parquet(f"file://{tmp_path}/encoder-0/dictionaries-0")
    assert moved.count() == moved.select("b", "term").distinct().count() == 40
    monkeypatch.setattr(encoder, "BLOCK", 3000)
    many, again = vectors(docs), vectors(split)
    assert 40 < spark.read.parquet(f"file://{tmp_path}/encoder-1/dictionaries-0").count() <= 40 * 20
    assert one.shape == (300, 16) and np.allclose(one @ one.T, many @ many.T, atol=1e-5) and np.allclose(one @ one.T, again @ again.T, atol=1e-5)


def test_larger_table_moves_once(spark):
    """Points of the larger table are not copied, those of the smaller one only to the parts that their own circle touches."""
    rng = random.Random(6)
    spot = lambda n: [(i, rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(n)]
    h, p = spark.createDataFrame(spot(2000), "h int, x double, y double"), spark.createDataFrame(spot(30), "p int, x double, y double")
    inside, around = spatial.dealt(h, p, 1000.0, F.lit(500.0), most=100)
    whole = spatial.dealt(h, p, 1000.0, most=100)[1]
    assert inside.count() == 2000 and around.count() < 0.6 * whole.count()
    plan = spatial.within(h, p, 1000.0)._jdf.queryExecution().optimizedPlan().toString()
    copied = [line for line in plan.splitlines() if "Generate explode" in line and "_hx" in line]
    assert "_px" in plan and not copied


def test_table_candidates_over_batches(spark):
    """Pages go on over the ends of Arrow batches, none runs into the next, null names are pages of their own; no page is a group of its own in Python."""
    rng = random.Random(9)
    rows = [(f, p, rng.randrange(4) * 2, i, f"{f}{p}.{i}", rng.choice([0.0, 30.0, 61.0, 90.5]) + rng.choice([0.0, 0.0, 0.0, 5.0]), 10.0) for f in ("a", "b", None) for p in (1, 2, None) for i in range(rng.randrange(25) + 1)]
    want = {}
    for key in {r[:2] for r in rows}:
        held = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[2], r[5], r[3]))
        numbers = sorted({r[2] for r in held})
        ends, reach = [], None
        for x in sorted({r[5] for r in held}):
            ends += [(reach + x) / 2] if reach is not None and x - reach >= 15 else []
            reach = x + 10 if reach is None else max(reach, x + 10)
        starts = [x for x in sorted({r[5] for r in held}) if len({r[2] for r in held if r[5] == x}) >= 0.6 * len(numbers)]
        for strategy, cuts in (("gaps", ends), ("aligned", [x - 1e-6 for x in starts[1:]])):
            column = lambda x: sum(x >= c for c in cuts)  # noqa: B023, E731
            want[*key, strategy] = [[" ".join(r[4] for r in held if r[2] == n and column(r[5]) == c) for c in range(len(cuts) + 1)] for n in numbers]
    words = spark.createDataFrame(rows, "file string, page int, line_no int, seq int, text string, x double, width double")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        found = layout.table_candidates(words)
        got = {(r["file"], r["page"], r["strategy"]): r["cells"] for r in found.collect()}
        plan = layout.best_tables(found)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert got == want and "InPandas" not in plan and plan.count("MapInArrow") == 1
