"""The pipeline's stages, each against a plain version on the stage's own input."""

from __future__ import annotations

import numpy as np
import corpus_pipeline
from pyspark.sql import functions as F

from lodestrata.llm import pfair, toxicity
from tests.llm import brute
from tests.llm.test_operators import check_packing, library, none, odd  # noqa: F401


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held, names = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held[-1], sf).write.parquet(str(tmp_path / name))
        held.append(spark.read.parquet(str(tmp_path / name)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    rows = [{r["doc_id"]: r for r in df.collect()} for df in held[:-1]]
    assert all(df.columns == names for df in held[:-1])
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert set(rows[1]) == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    groups, _ = brute.near({i: r["text"] for i, r in rows[1].items()}, 5)
    assert set(rows[2]) == {i for i, c in groups.items() if i == c}
    assert set(rows[3]) == set(rows[2]) == set(rows[4])
    assert not any(brute.secrets(r["text"]) for r in rows[3].values())
    assert all(rows[3][i]["text"] == rows[2][i]["text"] for i in rows[2] if not brute.secrets(rows[2][i]["text"]) and rows[3][i]["n_chars"] == rows[2][i]["n_chars"])
    order = [r["doc_id"] for r in held[4].select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("m")).orderBy("f", "m").collect()]
    mixed = {r["doc_id"]: (r["slot"], r["place"]) for r in pfair.mix(held[3]).collect()}
    assert [mixed[i] for i in order] == sorted(mixed.values())
    lib = library()
    want = [(i, [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for i, r in rows[4].items()]
    assert check_packing(held[5].collect(), want) > 0.95
    assert np.isclose(held[5].agg(F.sum("length")).first()[0], sum(len(x) for _, x in want))


def test_stages_odd(spark, odd, none):  # noqa: F811
    """Nulls, empty and long texts, repeated rows, an empty table, and columns named like those of the work: every stage takes them and keeps the columns."""
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, "/root/testdata/sf0.001")
            rows = found.collect()
            assert name == "packing" or found.columns == docs.columns
            if name in ("secrets", "mixing"):
                assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, (r["doc_id"] for r in docs.collect())))
