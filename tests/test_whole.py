"""Queries over whole tables and texts that have no SQL, against brute force."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import layout, pages
from lodestrata.plans import catalog
from tests.helpers import same


def test_contexts_of_all(spark, sf, duck):
    """The documents of a context are the best of all documents by scores taken plainly."""
    docs, items = duck.execute("SELECT doc_id, text FROM documents").fetchall(), duck.execute("SELECT item_id, text FROM benchmark WHERE item_id % 20 = 0").fetchall()
    rows = {r["query_id"]: json.loads(r["context"])["documents"] for r in catalog.QUERIES["contexts"](spark, sf).where("layout = 'json'").collect()}
    assert len(rows) == len(items)
    words = lambda t: [w for w in re.findall("[가-힣a-zA-Z0-9]+", (t or "").lower()) if len(w) >= 2]
    held = {i: Counter(words(t)) for i, t in docs}
    often, mean = Counter(t for c in held.values() for t in c), sum(sum(c.values()) for c in held.values()) / len(held)
    for item, text in items:
        terms = set(words(text)) & set(often)
        weight = {t: math.log(1 + len(held) / often[t]) for t in terms}
        part = lambda t, c: math.floor(weight[t] * 1000 * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)))  # noqa: B023, E731
        scores = {i: sum(part(t, c) for t in terms if t in c) for i, c in held.items() if terms & set(c)}
        most = sum(math.floor(w * 1000 * 2.2) for w in weight.values())
        pool = sorted(scores, key=lambda i: (-scores[i], i))[:50]
        best = sorted(pool, key=lambda i: (-(scores[i] * 1000 // most), i))[:5]
        found = [d["metadata"]["source"] for d in rows[item]]
        assert found and found == [f"doc {i}" for i in best][: len(found)] and rows[item][0]["content"].split()[:40] == dict(docs)[best[0]].split()[:40]



def test_lines_of_all_words(spark, sf, tmp_path):
    """The paragraphs of all words of each page, ten a line; a heading starts one and ends it."""
    made = [(i, f"u{i}", "<html><body><p>" + " ".join(f"w{j}" if j % 70 else "[heading]" for j in range(1, n + 1)) + "</p></body></html>") for i, n in ((1, 60), (2, 61), (3, 437), (4, 5))]
    spark.createDataFrame(made, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for where in (str(tmp_path), sf):
        held = spark.read.parquet(f"{where}/pages.parquet").select("url", "page_id", T.words(pages.plain(F.col("html"))).alias("words")).collect()
        want = {}
        for r in held:
            number, after = 0, False
            for i in range(0, len(r["words"]), 10):
                line = "".join(r["words"][i : i + 10])
                heading = bool(re.search(layout.HEADINGS, line.strip(), re.ASCII))
                number += heading or after
                after = heading
                want.setdefault((r["url"], r["page_id"], number), []).append(line)
        got = {(r["file"], r["page"], r["paragraph_no"]): r["text"] for r in catalog.QUERIES["page_lines"](spark, where).collect()}
        assert max(len(r["words"]) for r in held) > 60 and got == {k: " ".join(v) for k, v in want.items()}


def test_lines_over_batches(spark):
    """Lines go on over the ends of Arrow batches, and none runs into the next page; null names are pages of their own."""
    rng = random.Random(3)
    rows = [(f, p, i, chr(97 + i % 26), float(rng.randrange(40)), rng.choice([None, *(k * 1.7 for k in range(30))]), int(rng.random() < 0.5)) for f in ("a", "b", None) for p in (1, 2, None) for i in range(rng.randrange(60) + 1)]
    rows.append(("c", 1, 0, "z", 1.0, 0.0, 1))
    want = {}
    for f, p in {(r[0], r[1]) for r in rows}:
        number, anchor = -1, None
        for r in sorted((r for r in rows if r[:2] == (f, p)), key=lambda r: (r[5] is None, r[5] or 0, r[4], r[2])):
            if anchor is None or (r[5] is not None and abs(r[5] - anchor) > layout.TOLERANCE):
                number, anchor = number + 1, r[5]
            want.setdefault((f, p, number), []).append(r)
    chars = spark.createDataFrame(rows, "file string, page int, seq int, text string, x double, top double, bold int")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = {(r["file"], r["page"], r["line_no"]): r for r in layout.lines(chars).collect()}
    finally:
        spark.conf.set(name, before)
    assert set(got) == set(want)
    for key, held in want.items():
        held.sort(key=lambda r: (r[4], r[2]))
        tops = [r[5] for r in held if r[5] is not None]
        r = got[key]
        assert (r["text"], r["is_bold"]) == ("".join(h[3] for h in held), sum(h[6] for h in held) * 2 >= len(held))
        assert math.isclose(r["x"], sum(h[4] for h in held) / len(held)) and (r["top"] == tops[0] if tops else r["top"] is None)


def test_every_document_is_a_candidate(spark, sf, duck):
    """Reranking scores all documents for each item, and its best five are those of all documents."""
    n = duck.execute("SELECT (SELECT count(*) FROM documents) * (SELECT count(*) FROM benchmark WHERE item_id % 20 = 0)").fetchone()[0]
    scored = catalog.QUERIES["rerank_scores"](spark, sf).select("query_id", "doc_id", "by_keywords").collect()
    assert len(scored) == n == catalog.QUERIES["simple_rerank"](spark, sf).count()
    best = {(r["query_id"], r["rank"]): r["doc_id"] for r in catalog.QUERIES["rerank_ranked"](spark, sf).collect()}
    mine = {r["doc_id"]: r["by_keywords"] for r in scored if r["query_id"] == 0}
    ranked = [mine[best[0, rank]] for rank in range(1, 6)]
    assert ranked == sorted(mine.values(), reverse=True)[:5]


def test_candidates_beyond_fifty(spark, tmp_path):
    """Contexts, metrics and rerankers rank all documents: 60 that share a word with the item, and those with none of its words; as SQL has it."""
    rows = [(i, None if i == 7 else f"{'alpha ' * (1 + i % 3)}w{i} beta" + " x" * (i % 9)) for i in range(60)] + [(i, f"gamma delta{i}") for i in range(60, 70)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "Alpha words"), (20, "none of these"), (40, "delta66 w3"), (41, "alpha")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {name: catalog.QUERIES[name](spark, str(tmp_path)) for name in ("rerank_ranked", "simple_rerank", "context_budget", "contexts", "context_qa", "ir_metrics")}
    assert got["simple_rerank"].count() == 3 * 70
    assert all(Counter(r["query_id"] for r in got[name].collect()) == {0: 5, 20: 5, 40: 5} for name in ("rerank_ranked", "context_budget"))
    for name, df in got.items():
        same(df, c.execute(catalog.ORACLE[name]))


def _unhinted(spark, sf, name):
    """The plan of a query where only hints broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["understanding", "ir_summary", "contexts", "ir_metrics", "search_log"])
def test_texts_are_not_shuffled(spark, sf, name):
    """Only the texts of the best documents leave the task that reads them."""
    assert "Exchange hashpartitioning(doc_id" not in _unhinted(spark, sf, name)


def test_vectors_are_not_shuffled(spark, sf):
    """Only the vectors of items and of their candidates leave the task that reads them."""
    plan = _unhinted(spark, sf, "semantic_rerank")
    assert plan.count("FileScan parquet [vec_id") == plan.count("LeftSemi, BuildRight") == 2


def test_units_with_ties(spark, tmp_path):
    """Rows of one key and line number give the same unit in whatever order they lie."""
    kind, rows = "l_orderkey bigint, l_returnflag string, l_linestatus string, l_linenumber int, l_quantity double", [(k, "N", "O", 1, float(q)) for k in range(20) for q in (9, 4, 7, 30)]
    for number, held in enumerate((rows, rows[::-1])):
        spark.createDataFrame(held, kind).coalesce(1).write.parquet(f"{tmp_path}/{number}/lineitem.parquet")
    first, second = (sorted(map(tuple, catalog.QUERIES["dedupe_units"](spark, f"{tmp_path}/{n}").collect())) for n in (0, 1))
    assert first == second and first[3][2] == "space_" + hashlib.md5(b"3_N_O_4.0").hexdigest()[:12]


def test_tables_of_repeated_pages(spark, tmp_path):
    """Each table of a file once, whatever pages it is on, and lines as one column where that scores more; as SQL has it."""
    page = lambda *words: f"<html><body><p>{' '.join(words)}</p></body></html>"
    many, few = page(*(f"w{i}" for i in range(37))), page("1", *"abcdefghi", "2")
    made = [(1, "u", many), (2, "u", many), (3, "v", many), (4, "v", few), (5, "v", few), (6, None, many), (7, "w", page("one"))]
    spark.createDataFrame(made, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES["page_tables"](spark, str(tmp_path))
    assert sorted((r["page"], r["strategy"]) for r in got.collect()) == [(1, "gaps"), (3, "gaps"), (4, "aligned"), (6, "gaps"), (7, "gaps")]
    same(got, c.execute(catalog.ORACLE["page_tables"]))
