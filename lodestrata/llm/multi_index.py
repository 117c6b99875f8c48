"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own, and the two together
form a product grid of cells. Every vector lies in the cell of its nearest two codewords.
A query walks the grid in the order of its distance to the cells (multi-sequence
traversal: two sorted lists of codewords and a heap) and stops where pairs right at the
threshold would have been met with the target recall. Pairs that share a visited cell are
verified by cosine in double precision.

Codebooks and the stop are fitted on a bounded sample; every vector is indexed and queried.
Equal vectors form one class first. Visits are rows of ids; vectors, as bytes, are joined to
those alone that meet in a cell. Cells are compared in blocks, each pair of blocks a group of
its own, and of a block pair only each vector's number of links and the root of its component
go on, never its pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.llm.common import components, materialise, roots, small_batches

COSINE = 0.98
#: Vectors the codebooks and the stop are fitted on, at most.
SAMPLE = 10_000
#: Share of simulated pairs at the threshold that the traversal must meet, and a margin on the stop.
RECALL, MARGIN = 0.9999, 1.25
#: Vectors of a cell that are compared at once.
BLOCK = 256
ROUNDS = 8


@dataclass
class Index:
    """Two codebooks, and how far beyond the nearest cell a query goes (squared distance)."""

    first: np.ndarray
    second: np.ndarray
    slack: float


def codewords(n: int, sample: int = SAMPLE) -> int:
    """Codewords of each half for ``n`` vectors: cells grow with the table, as far as each codeword has four vectors of the sample."""
    return int(max(4, min(sample // 4, 2 ** round(math.log2(max(n, 1) ** 0.5 / 4 + 1)))))


def squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :], 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by Lloyd's rounds from distinct rows."""
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = squared(x, words).argmin(1)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(words))
        words = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], words)
    return words


def fit(x: np.ndarray, k: int, cosine: float = COSINE, recall: float = RECALL, seed: int = 7) -> Index:
    """The index of a sample of unit vectors; the stop is read off partners made at exactly ``cosine``."""
    rng, half = np.random.default_rng(seed), x.shape[1] // 2
    first, second = codebook(x[:, :half], k, rng), codebook(x[:, half:], k, rng)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    size = np.linalg.norm(noise, axis=1)[:, None]
    partner = cosine * x + np.sqrt(1 - cosine**2) * np.divide(noise, size, out=np.zeros_like(noise), where=size > 0)
    d1, d2 = squared(partner[:, :half], first), squared(partner[:, half:], second)
    at = np.arange(len(x))
    beyond = d1[at, squared(x[:, :half], first).argmin(1)] - d1.min(1) + d2[at, squared(x[:, half:], second).argmin(1)] - d2.min(1)
    return Index(first, second, float(np.quantile(beyond, recall)) * MARGIN + 1e-9)


def traverse(d1: np.ndarray, d2: np.ndarray, slack: float) -> list[tuple[int, int]]:
    """Cells in the order of d1[i] + d2[j], up to ``slack`` beyond the nearest."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1], d2[o2]
    limit = s1[0] + s2[0] + slack
    a, b = s1[: int(np.searchsorted(s1, limit - s2[0], "right"))].tolist(), s2[: int(np.searchsorted(s2, limit - s1[0], "right"))].tolist()
    heap, out = [(a[0] + b[0], 0, 0)], []
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > limit:
            break
        out.append((int(o1[i]), int(o2[j])))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def matrix(column: pa.Array, size: int, kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of a column of vectors as bytes; scaled first, so that no square overflows."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=kind).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _encode(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes: equal ones, of whichever sign their zeros are, have equal bytes."""
    for batch in batches:
        lists = batch["embedding"]
        data = (np.asarray(lists.flatten()).astype(kind) + np.array(0, dtype=kind)).tobytes()
        width, ends = np.dtype(kind).itemsize, np.asarray(lists.value_lengths()).cumsum().tolist()
        held = pa.array([data[width * i : width * j] for i, j in zip([0, *ends], ends, strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], lists.value_lengths().cast(pa.int32()), held], ["vec_id", "label", "size", "v"])


def _visit(batches: Iterator[pa.RecordBatch], index: Index, size: int, kind: str) -> Iterator[pa.RecordBatch]:
    half, width = index.first.shape[1], len(index.second)
    for batch in batches:
        if not len(batch):
            continue
        x = matrix(batch["v"], size, kind)
        d1, d2 = squared(x[:, :half], index.first), squared(x[:, half:], index.second)
        rows, cells, home = [], [], []
        for r in range(len(x)):
            found = traverse(d1[r], d2[r], index.slack)
            rows += [r] * len(found)
            cells += [i * width + j for i, j in found]
            home += [True] + [False] * (len(found) - 1)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_pydict({"label": batch["label"].take(take), "id": batch["id"].take(take), "print": batch["print"].take(take), "cell": pa.array(cells, pa.int64()), "home": pa.array(home)})


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, kind: pa.DataType, number: str) -> Iterator[pa.RecordBatch]:
    """Per block pair: for each class with a link the weight of its partners, and the smallest id of its component."""
    schema = pa.schema([("id", kind), ("print", pa.int64()), ("links", pa.int64()), ("root", kind)])
    for batch in batches:
        for row, size in enumerate(batch["size"].to_pylist()):
            sides = []
            for name in ("asking", "held"):
                s = batch[name].slice(row, 1).flatten()
                sides.append((s.field("id").to_pylist(), s.field("print").to_pylist(), np.asarray(s.field("weight")), matrix(s.field("v"), size, number)))
            (q, qp, qw, x), (h, hp, hw, y) = sides
            hit = (x @ y.T >= cosine) & (np.array(q)[:, None] < np.array(h)[None, :])
            if not hit.any():
                continue
            # An id may stand for several classes, each with links of its own.
            keys = [*zip(q, qp, strict=True), *zip(h, hp, strict=True)]
            classes = sorted(set(keys))
            no = {c: n for n, c in enumerate(classes)}
            place = np.array([no[k] for k in keys])
            links = np.zeros(len(classes), dtype=np.int64)
            np.add.at(links, place[: len(q)], hit @ hw)
            np.add.at(links, place[len(q) :], hit.T @ qw)
            joined = np.zeros((len(classes), len(classes)), dtype=bool)
            i, j = np.nonzero(hit)
            joined[place[: len(q)][i], place[len(q) :][j]] = True
            root = roots(joined | joined.T)
            some = np.flatnonzero(links).tolist()
            columns = [[classes[n][0] for n in some], [classes[n][1] for n in some], links[some], [classes[root[n]][0] for n in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that can have links."""
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    return vectors.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole & some)


def build(classes: DataFrame, kind: str, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE) -> dict[int, Index]:
    """An index for each length of vector in the table, fitted on at most ``sample`` vectors in the order of a hash."""
    out = {}
    lengths = classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()  # a handful of lengths
    for size, n in lengths:
        some = classes.where(F.col("size") == size).orderBy(F.xxhash64("id")).limit(sample).select("v").toArrow()
        out[size] = fit(matrix(some["v"].combine_chunks(), size, kind), codewords(n, sample), cosine, recall)
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """Columns vec_id, n_links, component_id and kept, one row per input row.

    Rows are linked if their labels are equal and their cosine is at least ``cosine``.
    Vectors that are null, empty, zero, or hold a null or non-finite component, and rows of
    null label, have no link. Vectors of different lengths are never compared. Rows that
    share a vec_id count as one vertex, whose links add up; a null vec_id has no link, a null component, and is kept.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    name = vectors.schema["vec_id"].dataType.simpleString()
    label = vectors.schema["label"].dataType.simpleString()
    number = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    kind = to_arrow_type(vectors.schema["vec_id"].dataType)
    real = materialise(usable(vectors).mapInArrow(partial(_encode, kind=number), f"vec_id {name}, label {label}, size int, v binary"), "vectors")
    classes = materialise(real.groupBy("label", "size", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumn("print", F.xxhash64("v")), "vector-classes")
    visits = None
    for size, index in build(classes, number, cosine, recall, sample).items():
        part = classes.where(F.col("size") == size).select("label", "id", "print", "v")
        seen = part.mapInArrow(partial(_visit, index=index, size=size, kind=number), f"label {label}, id {name}, print long, cell long, home boolean").withColumn("size", F.lit(size))
        visits = seen if visits is None else visits.unionByName(seen)
    everything = vectors.select("vec_id")
    if visits is None:
        return everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    visits = materialise(visits, "visits")
    keys = ["size", "label", "cell"]
    cells = visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked"), F.count_if("home").alias("lying")).where("asked > 1 AND lying > 0")
    cells = cells.select(*keys, F.ceil(F.col("asked") / BLOCK).alias("n_asking"), F.ceil(F.col("lying") / BLOCK).alias("n_held"))
    met = visits.join(cells, keys)
    # Each vector goes to the pairs of its block where it lies, so that no task holds a cell.
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = met.select("id", "print", *keys, F.pmod(F.xxhash64("id"), "n_asking").alias("i"), every("n_held").alias("j"), F.lit(True).alias("asks"))
    held = met.where("home").select("id", "print", *keys, every("n_asking").alias("i"), F.pmod(F.xxhash64("id"), "n_held").alias("j"), F.lit(False).alias("asks"))
    # Rows that share an id may lie in several classes, which their prints tell apart.
    dealt = asking.unionByName(held).join(classes.select("id", "print", "label", "size", "weight", "v"), ["id", "print", "label", "size"])
    member = F.struct("id", "print", "weight", "v")
    pairs = dealt.groupBy(*keys, "i", "j").agg(F.collect_list(F.when(F.col("asks"), member)).alias("asking"), F.collect_list(F.when(~F.col("asks"), member)).alias("held"))
    pairs = pairs.where("size(asking) > 0 AND size(held) > 0").select("size", "asking", "held")
    found = materialise(pairs.mapInArrow(partial(_compare, cosine=cosine, kind=kind, number=number), f"id {name}, print long, links long, root {name}"), "vector-links")
    linked = found.groupBy("id", "print").agg(F.sum("links").alias("links"))
    repeated = real.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    own = real.join(repeated, "vec_id").join(classes.select("label", "size", "v", "id"), ["label", "size", "v"])  # an id's classes belong together
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(own.select(F.col("id").alias("a"), F.col("vec_id").alias("b"))).where("a != b"))
    each = classes.join(linked, ["id", "print"], "left").join(labels, "id", "left")
    each = each.select("label", "size", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component_id", "id").alias("component_id"))
    return _per_row(everything, real.join(each, ["label", "size", "v"]))


def _per_row(everything: DataFrame, placed: DataFrame) -> DataFrame:
    """Back to the input rows; rows that share a vec_id take the sum of their links and the smallest component."""
    own = placed.groupBy(F.col("vec_id").alias("id")).agg(F.sum("links").alias("links"), F.min("component_id").alias("component"))
    joined = everything.join(own, everything["vec_id"] == own["id"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def digest(vectors: DataFrame) -> DataFrame:
    """The op1 columns of embeddings."""
    return near_vectors(vectors)
