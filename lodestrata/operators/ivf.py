"""Nearest neighbours by cosine from an inverted file with residual product codes.

Unit vectors lie in the list of their nearest centroid; the rest, vector less centroid, is kept as
one byte a stretch of components: the nearest of up to 256 codewords. A query visits the lists of its
nearest centroids, ranks the codes there by table look-ups, and only the best candidates' vectors are
read and compared exactly. Centroids, codewords, the number of lists to visit and of candidates are
fitted on a bounded sample: the last two are the least that found TARGET of the true neighbours there.

The index is a table partitioned by list. A list is searched in blocks of rows and of queries, each pair a
task's group of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.functions.vectors import cosine
from lodestrata.session import shared_folder

#: Vectors the index is fitted on, at most; queries among them that the search is tuned by.
SAMPLE, TUNED = 10_000, 200
#: Components of a code byte, rounds of k-means, lists at most.
STRETCH, ROUNDS, LISTS = 4, 8, 4096
#: Share of true neighbours the tuned search must find in the sample, and the number of neighbours.
TARGET, NEAREST = 0.98, 5
#: Rows and queries of a block, and queries whose distances are taken at once.
BLOCK, ASKED, TOGETHER = 8192, 256, 64


@dataclass
class Model:
    """Centroids, a codebook for each stretch of components, lists to visit and candidates to compare."""

    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int
    depth: int


@dataclass
class IvfIndex:
    """``codes`` (id, list, code, deal) partitioned by list, the vectors themselves, and the model."""

    codes: DataFrame
    vectors: DataFrame
    model: Model


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _squared(x, words).argmin(1)
        sums, n = np.zeros_like(words), np.bincount(near, minlength=len(words))
        np.add.at(sums, near, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def _stretches(size: int) -> list[slice]:
    return [slice(i, min(i + STRETCH, size)) for i in range(0, size, STRETCH)]


def encode(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """List and code of unit vectors."""
    lists = _squared(x, model.centroids).argmin(1)
    rest = x - model.centroids[lists]
    codes = [_squared(rest[:, s], book).argmin(1) for s, book in zip(_stretches(x.shape[1]), model.books, strict=True)]
    return lists, np.stack(codes, 1).astype(np.uint8)


def distances(query: np.ndarray, centroid: np.ndarray, codes: np.ndarray, model: Model) -> np.ndarray:
    """Approximate squared distances of a query to the codes of one list."""
    rest = query - centroid
    tables = [((rest[s] - book) ** 2).sum(1) for s, book in zip(_stretches(len(query)), model.books, strict=True)]
    return sum(t[codes[:, i]] for i, t in enumerate(tables))


def fit(x: np.ndarray, n: int, seed: int = 5) -> Model:
    """The model of a sample of unit vectors for a table of ``n``; deterministic."""
    rng = np.random.default_rng(seed)
    k = int(max(1, min(LISTS, len(x) // 8, round(n**0.5 / 2))))
    model = Model(_means(x, k, rng), [], 1, NEAREST)
    rest = x - model.centroids[_squared(x, model.centroids).argmin(1)]
    model.books = [_means(rest[:, s], 256, rng) for s in _stretches(x.shape[1])]
    lists, codes = encode(x, model)
    tuned, most = x[:TUNED], min(NEAREST, len(x) - 1)
    turn = np.argsort(_squared(tuned, model.centroids), axis=1, kind="stable").argsort(1)  # place of each list in a query's order
    scores = tuned @ x.T
    scores[np.arange(len(tuned)), np.arange(len(tuned))] = -2
    true = np.argsort(-scores, axis=1, kind="stable")[:, :most]
    if true.size:
        visits = turn[np.arange(len(tuned))[:, None], lists[true]]
        model.probes = int(np.quantile(visits, TARGET, method="higher")) + 1
        near = np.full(scores.shape, np.inf)
        for one in range(len(model.centroids)):
            at = np.flatnonzero(lists == one)
            for q in np.flatnonzero(turn[:, one] < model.probes):
                near[q, at] = distances(tuned[q], model.centroids[one], codes[at], model)
        places = near.argsort(1, kind="stable").argsort(1)[np.arange(len(tuned))[:, None], true]
        model.depth = int(np.quantile(places, TARGET, method="higher")) + 1 + NEAREST
    return model


def _units(column: pa.Array, size: int) -> np.ndarray:
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), size)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _placed(batches: Iterator[pa.RecordBatch], model: bytes, size: int) -> Iterator[pa.RecordBatch]:
    held = pickle.loads(model)  # noqa: S301 - our own model
    for batch in batches:
        lists, codes = encode(_units(batch["embedding"], size), held)
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "list", "code"])


def _asked(batches: Iterator[pa.RecordBatch], model: bytes, size: int) -> Iterator[pa.RecordBatch]:
    held = pickle.loads(model)  # noqa: S301
    for batch in batches:
        x = _units(batch["query_embedding"], size)
        nearest = np.argsort(_squared(x, held.centroids), axis=1, kind="stable")[:, : held.probes]
        yield pa.RecordBatch.from_arrays([batch["query_id"], batch["query_embedding"], pa.array(nearest.tolist(), pa.list_(pa.int32()))], ["query_id", "query_embedding", "lists"])


def _ranked(key: tuple, asked: pa.Table, rows: pa.Table, model: bytes, size: int, depth: int, kinds: pa.Schema) -> pa.Table:
    """The best ``depth`` codes of a block for each query of a block."""
    if not len(asked) or not len(rows):
        return kinds.empty_table()
    held = pickle.loads(model)  # noqa: S301
    rows = rows.take(pc.sort_indices(rows["id"]))
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(rows), -1)
    rest = _units(asked["query_embedding"].combine_chunks(), size) - held.centroids[key[0].as_py()]
    tables = [_squared(rest[:, s], book) for s, book in zip(_stretches(size), held.books, strict=True)]
    best, near = [], []
    for start in range(0, len(rest), TOGETHER):
        far = np.zeros((len(rest[start : start + TOGETHER]), len(rows)))
        for i, table in enumerate(tables):
            far += table[start : start + TOGETHER].take(codes[:, i], axis=1)
        if depth < len(rows):
            # Those of the depth-th distance or less, then the first of them in order of distance and id.
            most = np.partition(far, depth - 1, axis=1)[:, depth - 1 : depth]
            order = np.argsort(np.where(far <= most, far, np.inf), axis=1, kind="stable")[:, :depth]
        else:
            order = np.broadcast_to(np.arange(len(rows)), far.shape)
        best.append(order)
        near.append(np.take_along_axis(far, order, 1))
    best, near = np.concatenate(best), np.concatenate(near)
    asking = np.repeat(np.arange(len(best)), best.shape[1])
    return pa.table([asked["query_id"].take(asking), rows["id"].take(best.ravel()), pa.chunked_array([pa.array(near.ravel())])], schema=kinds)


def usable(rows: DataFrame, column: str, size: int) -> DataFrame:
    """Rows whose vector has ``size`` finite components that are not all zero."""
    v = F.col(column)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where((F.size(v) == size) & whole & F.exists(v, lambda x: x != 0))


def build(vectors: DataFrame, size: int, folder: str | None = None, sample: int = SAMPLE) -> IvfIndex:
    """Index (id, embedding) of ``size`` components. Ids are whole numbers; vectors that are null, zero, not finite or of another length are left out."""
    spark = vectors.sparkSession
    folder = folder or shared_folder(spark, "ivf")
    rows = usable(vectors.select("id", "embedding").where("id IS NOT NULL"), "embedding", size)
    some = rows.orderBy(F.xxhash64("id", "embedding")).limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    model = fit(_units(some, size), rows.count()) if len(some) else Model(np.zeros((1, size)), [np.zeros((1, s.stop - s.start)) for s in _stretches(size)], 1, NEAREST)
    name = rows.schema["id"].dataType.simpleString()
    coded = rows.mapInArrow(partial(_placed, model=pickle.dumps(model), size=size), f"id {name}, list int, code binary")
    # A crowded list is written, and searched, in parts.
    coded.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(1 << 20))).repartition("list", F.col("deal") % 8).write.partitionBy("list").parquet(f"{folder}/codes")
    kinds = "id " + name + ", code binary, deal bigint, list int"
    return IvfIndex(spark.read.schema(kinds).parquet(f"{folder}/codes"), rows, model)


def search(index: IvfIndex, queries: DataFrame, k: int = NEAREST, size: int | None = None) -> DataFrame:
    """query_id, id, similarity and rank of about the ``k`` nearest vectors of (query_id, query_embedding), compared exactly; ties go to the smaller id."""
    size = size or index.model.centroids.shape[1]
    model, depth = pickle.dumps(index.model), max(index.model.depth, k)
    asking = usable(queries.select("query_id", "query_embedding"), "query_embedding", size)
    name, q_name, v_name = index.codes.schema["id"].dataType.simpleString(), asking.schema["query_id"].dataType.simpleString(), asking.schema["query_embedding"].dataType.simpleString()
    visits = asking.mapInArrow(partial(_asked, model=model, size=size), f"query_id {q_name}, query_embedding {v_name}, lists array<int>")
    visits = visits.select("query_id", "query_embedding", F.explode("lists").alias("list"))
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sizes = index.codes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_rows"))
    asked = visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("n_asked"))
    blocks = F.broadcast(sizes.join(asked, "list"))  # a row a list
    left = visits.join(blocks, "list").withColumn("i", F.pmod(F.xxhash64("query_id"), "n_asked")).withColumn("j", many("n_rows")).drop("n_rows", "n_asked")
    right = index.codes.join(blocks, "list").withColumn("j", F.pmod("deal", "n_rows")).withColumn("i", many("n_asked")).drop("n_rows", "n_asked", "deal")
    key = ["list", "i", "j"]
    kinds = pa.schema([("query_id", to_arrow_type(asking.schema["query_id"].dataType)), ("id", to_arrow_type(index.codes.schema["id"].dataType)), ("far", pa.float64())])
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(partial(_ranked, model=model, size=size, depth=depth, kinds=kinds), f"query_id {q_name}, id {name}, far double")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "id"))
    best = met.withColumn("turn", turn).where(F.col("turn") <= depth).select("query_id", "id")
    exact = best.join(index.vectors, "id").join(asking, "query_id").select("query_id", "id", cosine(F.col("embedding"), F.col("query_embedding")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k)
