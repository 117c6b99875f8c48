"""The prefix trie, line runs and hard negatives against plain versions, and on the odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestrata.llm import hard_negatives, line_runs, prefix_trie
from lodestrata.llm.common import shared_dir

#: Names that the operators use for columns of their own.
CLASHING = "block place no c1 c2 tokens first before h k base head x1 x2 p1 p2 own last salt leaf depth conv owner batch row r_id d_id line key at h1 h2 dropped text_key near cell norm size v deal i j routes rank".split()


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    paths = {}
    for c, own in turns.items():
        own = [t[1:] for t in sorted(own)]
        base = [t[1:] for t in sorted(turns.get(c - int(math.fmod(c, 20)), []))]
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(base[:h] + own[h:])
    members = defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    words = lambda p: len(p[-1][1].encode().split()) if p else 0
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * words(p) + sum(saved[q] for q in children[p])
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(paths[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NODES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in CLASHING))


def nodes(df):
    return sorted((tuple(r[c] for c in NODES) for r in df.collect()), key=str)


@pytest.mark.parametrize("piece", [2, 4096])
def test_prefix_trie(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rng = random.Random(5)
    rows = []
    for c in range(120):
        first = rng.choice(["hi there", "hi there", "hi there", "good  day\tto you", ""])
        rows += [(c, t, rng.choice(["user", None]) if t else "user", first if t == 0 else rng.choice(["a b", "c", None, "a　b c", "x\x1cy z"])) for t in range(rng.randrange(1, 7))]
    rows += [(200 + i, t, "user", "same words in all of them") for i in range(60) for t in range(5)]
    rows += [(400, t, "user", f"turn {t}") for t in range(300)] + [(401, t, "user", f"turn {t}") for t in range(280)]
    rows += [(500, None, None, None), (500, None, None, "z"), (500, 3, "b", "tie"), (500, 3, "a", "tie"), (500, 3, "a", "tie"), (-7, 1, "user", "below zero"), (None, 1, "user", "no id"), (2**60 + 1, 0, "user", "long " * 100_000)]
    assert nodes(prefix_trie.digest(conversations(spark, rows))) == plain_trie(rows)


def test_prefix_trie_empty(spark):
    assert prefix_trie.digest(conversations(spark, [])).count() == 0
    assert prefix_trie.digest(conversations(spark, [(None, 1, "user", "x")])).count() == 0
    # No base, and the only turn is among the first ones that a base would give.
    c = next(i for i in range(61, 80) if zlib.crc32(str(i).encode()) % 4)
    assert nodes(prefix_trie.digest(conversations(spark, [(c, 0, "user", "x")]))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def plain_lines(rows):
    """doc_id, n_lines, n_dropped, kept text of each row; rows without an id are one document, the last."""
    order = lambda i: (i is None, i or 0)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), order(i)), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_docs(spark, rows):
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))


def line_rows(rng, n=160):
    pool = [f"{'Repeated' if i % 2 else 'REPEATED'} line number {i % 37}" for i in range(60)] + ["short", "", "  ", "exactly10c", "nine char", "Ünïcode LINE İ with words", "  ünïcode line"]
    rows = [(rng.randrange(10**6), "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t\x0b"]) for _ in range(rng.randrange(1, 9)))) for _ in range(n)]
    rows += [(7, None), (8, ""), (9, "\n"), (9, "\n"), (9, "Repeated line number 1\nand more of the same"), (None, "a line without an id\nRepeated line number 1"), (None, "a line without an id"), (2**60 + 1, "a big id's own line"), (2**60 + 3, "A big id's own line \n")]
    return [*rows, (10, "\n".join(f"a long text's line {i % 4000}" for i in range(20_000))), (11, "\n".join(f"A long text's line {i}" for i in range(20_000)))]


def test_line_runs(spark):
    rows = line_rows(random.Random(2))
    start = time.time()
    got = line_runs.deduplicate_lines(line_docs(spark, rows), batches=5, fanout=2).collect()
    assert time.time() - start < 120
    assert sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got), key=str) == sorted(plain_lines(rows), key=str)
    assert [r["row"]["key"] for r in got] == ["key"] * len(rows)
    assert line_runs.digest(line_docs(spark, [])).count() == 0


def test_line_runs_resumed(spark):
    """Batch after batch, with the runs opened anew each time, and a run of a lost job left lying about."""
    rows = sorted(r for r in line_rows(random.Random(3)) if r[0] is not None and r[1])
    home, drops = f"{shared_dir(spark)}/runs-test-{time.time_ns()}", None
    for n in range(4):
        batch = line_docs(spark, [r for r in rows if len([1 for c in (10**5, 10**5 * 4, 10**5 * 8) if r[0] > c]) == n])
        runs = line_runs.LineRuns(spark, home, 4, fanout=2)
        assert runs.step == n and len(runs.runs()) <= 3
        if n == 2:
            runs._write(line_runs.keyed_lines(batch).selectExpr("h1", "h2", "doc_id AS owner").distinct(), 0)
            runs = line_runs.LineRuns(spark, home, 4, fanout=2)
        found = spark.createDataFrame(line_runs.repeated(line_runs.keyed_lines(batch), runs).collect(), "doc_id long, text_key long, at int")
        drops = found if drops is None else drops.unionByName(found)
    got = line_runs.apply_drops(line_docs(spark, rows), drops).collect()
    assert sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got), key=str) == sorted(plain_lines(rows), key=str)


def plain_negatives(rows, every=10):
    held = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(np.float64(np.float32(x)) * 256)) for x in v)))
    out = []
    for a, la, x in sorted({r for r in held if r[0] % every == 0}):
        scores = sorted((-max(1 - 2**63, min(2**63 - 1, sum(p * q for p, q in zip(x, y, strict=True)))), b, lb == la) for b, lb, y in held if b != a and len(y) == len(x))
        for p, b in [(-s, b) for s, b, same in scores if same][:5]:
            fit = [(b2, -s) for s, b2, same in scores if not same and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(a, b, n, b2, p, s) for n, (b2, s) in enumerate(fit, 1)]
    return sorted(out)


def negative_rows(seed, n=400, dims=8, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 2
    rows = [(i, [float(x) for x in (centres[rng.integers(6)] + rng.normal(size=dims) * 0.3) * scale], int(rng.integers(4))) for i in range(n)]
    rows += [(n + i, rows[20][1], 1) for i in range(80)]  # ties
    return [*rows, rows[5], rows[20], (20, rows[7][1], 2), (3000, None, 1), (3010, [None] * dims, 1), (3020, [float("nan")] * dims, 1), (3030, rows[3][1], None), (None, rows[3][1], 1), (3040, [], 1), (3050, [], 2), (3060, [0.0] * dims, 3), (3070, [1.0, 2.0], 1), (3071, [1.0, 2.0], 1), (3072, [0.6, 1.0], 2)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 3e7])
def test_hard_negatives(spark, monkeypatch, scale):
    for name, value in (("GROUP", 8), ("BLOCK", 64), ("EACH", 3), ("ROWS", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = negative_rows(int(scale) % 97, scale=scale)
    df = spark.createDataFrame([(*r, *CLASHING) for r in rows], "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in CLASHING))
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, every=10).collect())
    want = plain_negatives(rows)
    assert got == want and len(want) > 300
    assert hard_negatives.digest(df.limit(0)).count() == 0


def test_hard_negatives_pruned(spark):
    """Of well separated clusters a group is served few rows, and nothing is lost."""
    rng = np.random.default_rng(1)
    centres = np.eye(12) * 40
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=12) * 0.2], i % 2) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    served, keep = [], hard_negatives._joined

    def counted(anchors, rows, function, schema):
        served.append(rows.count())
        return keep(anchors, rows, function, schema)

    hard_negatives._joined, each = counted, hard_negatives.EACH
    hard_negatives.EACH = 10
    try:
        got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, every=10).collect())
    finally:
        hard_negatives._joined, hard_negatives.EACH = keep, each
    assert got == plain_negatives(rows)
    assert served[0] < 0.5 * 12 * len(rows)
