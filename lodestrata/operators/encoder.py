"""A text encoder fitted on a corpus: tf-idf weights in a space of few dimensions.

Document frequencies weigh terms. A random direction for each term, told by hashes of it and a seed, gives every
text a sketch; summing the sketches of the texts that hold a term, by weight, turns its direction
towards those of the terms it occurs with (one round of a power iteration). The directions are made
orthonormal by the Gram matrix of their components, whose size is the square of the number of dimensions. Everything that grows
with the corpus is a table.

Texts are worked on in blocks, each with a dictionary of its own terms: a vector is moved once for each term and block, not for each
term and text, and in single precision; sums are in double.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import keyword_tokens
from lodestrata.session import shared_folder, small_batches

DIMENSIONS, SEED = 64, 11
#: Characters of a block of texts and, while there are fewer blocks than tasks at a time, of a smaller one; terms counted before they are handed on, texts times words at a time.
BLOCK, LEAST, TERMS, CELLS = 64 << 20, 8 << 20, 1_000_000, 1 << 20


def _direction(dimensions: int, seed: int) -> Column:
    """A term's random direction of +1 and -1: 32 signs a number, a set bit is +1."""
    return F.array(*[F.xxhash64(F.lit(seed + k), "term").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(math.ceil(dimensions / 32))])


def _texts(docs: DataFrame) -> DataFrame:
    """id, b (block) and words of (id, content): tokens with blanks between them; texts of one id are one text."""
    spark = docs.sparkSession
    small_batches(spark)
    held = docs.where("id IS NOT NULL").select("id", F.coalesce("content", F.lit("")).alias("content"))
    if held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        held = held.groupBy("id").agg(F.concat_ws(" ", F.collect_list("content")).alias("content"))
    size = held.agg(F.sum(F.length("content"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK), min(2 * spark.sparkContext.defaultParallelism, math.ceil(size / LEAST)))
    return held.select("id", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"), F.array_join(keyword_tokens(F.col("content")), " ").alias("words"))


def _dealt(df: DataFrame) -> DataFrame:
    """Dealt out by block."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "b")


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """b, term and n, texts of a block that have it; the row of a term may come in several parts."""
    found: dict[int, Counter] = defaultdict(Counter)

    def counted() -> Iterator[pa.RecordBatch]:
        for b, terms in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([b] * len(terms), pa.int32()), pa.array(list(terms), pa.string()), pa.array(list(terms.values()), pa.int64())], ["b", "term", "n"])
        found.clear()

    for batch in batches:
        for b, words in zip(batch["b"].to_pylist(), batch["words"].to_pylist(), strict=True):
            found[b].update(set(words.split()))
        if sum(map(len, found.values())) > TERMS:
            yield from counted()
    yield from counted()


def counted(texts: DataFrame) -> DataFrame:
    """b, term and n of _texts(): the terms of each block and how many of its texts have them."""
    return _dealt(texts.select("b", "words")).mapInArrow(_vocabulary, "b int, term string, n bigint")


def _behind(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of each block behind the terms (b, term, idf, v) of the block."""
    return _dealt(terms.unionByName(texts, allowMissingColumns=True)).sortWithinPartitions("b", F.col("term").isNull())


def _vectors(column: pa.Array, dimensions: int, packed: bool) -> np.ndarray:
    """A row of components a term."""
    held = np.asarray(column.flatten())
    if not packed:
        return held.reshape(-1, dimensions).astype("float32")
    bits = (held.reshape(-1, math.ceil(dimensions / 32))[:, :, None] >> np.arange(32)) & 1
    return (bits.reshape(len(column), -1)[:, :dimensions] * 2 - 1).astype("float32")


def _weighted(words: list[str], index: dict[str, int], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time their known terms and weights (a row a text): (1 + ln tf) * idf, as a share of the text's norm."""
    split, a = [w.split() for w in words], 0
    while a < len(split):
        b, n = a + 1, len(split[a])
        while b < len(split) and (b - a + 1) * (n + len(split[b])) <= CELLS:
            n += len(split[b])
            b += 1
        term = np.fromiter(map(index.get, chain.from_iterable(split[a:b]), repeat(-1)), "int64", n)
        text = np.repeat(np.arange(b - a), [len(x) for x in split[a:b]])[term >= 0]
        terms, column = np.unique(term[term >= 0], return_inverse=True)
        weight = np.bincount(text * len(terms) + column, minlength=(b - a) * len(terms)).reshape(b - a, len(terms)).astype("float64")
        some = weight > 0
        weight[some] = 1 + np.log(weight[some])
        weight *= idf[terms]
        norm = np.sqrt((weight * weight).sum(axis=1))
        yield terms, weight / np.where(norm > 0, norm, 1)[:, None]
        a = b


def _by_block(batches: Iterator[pa.RecordBatch], dimensions: int, packed: bool) -> Iterator[tuple[int, list, dict, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Of rows of _behind() each batch of texts with its block and the terms, places, idf and vectors of that."""
    last, names, index, idf, v, parts = None, [], {}, np.zeros(0), np.zeros((0, dimensions)), []
    for batch in batches:
        block, is_text = batch["b"].to_numpy(), batch["term"].is_null().to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (is_text[1:] != is_text[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            if a == b:
                continue
            piece = batch.slice(a, b - a)
            if block[a] != last:
                last, names, index, parts = block[a], [], {}, []
            if not is_text[a]:
                terms = piece["term"].to_pylist()
                for n, t in enumerate(terms, len(names)):  # a term may come twice: the first row stands
                    index.setdefault(t, n)
                names += terms
                parts.append((piece["idf"].to_numpy(), _vectors(piece["v"], dimensions, packed)))
                continue
            if parts is not None:
                idf = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
                v = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, dimensions), "float32")
                parts = None
            yield last, names, index, idf, v, piece


def _turned_to(batches: Iterator[pa.RecordBatch], dimensions: int, packed: bool) -> Iterator[pa.RecordBatch]:
    """term, idf and v: the sums of the sketches of a block's texts that hold the term, by weight."""
    last, held = None, None

    def sums() -> Iterator[pa.RecordBatch]:
        names, idf, total = held
        some = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(some), 4096):
            rows = some[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in rows.tolist()], pa.string()), pa.array(idf[rows]), _lists(total[rows], pa.float32())], ["term", "idf", "v"])

    for block, names, index, idf, v, piece in _by_block(batches, dimensions, packed):
        if block != last:
            if held:
                yield from sums()
            last, held = block, (names, idf, np.zeros((len(idf), dimensions)))
        for terms, weight in _weighted(piece["words"].to_pylist(), index, idf):
            held[2][terms] += weight.T @ (weight @ v[terms].astype("float64"))
    if held:
        yield from sums()


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel().astype(kind.to_pandas_dtype()), kind))


def _joined(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """term, idf and the sum of v of rows sorted by term; the last term of a batch may go on in the next."""
    open_ = None

    def row(terms: list, idf: list, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(idf, pa.float64()), _lists(v, pa.float32())], ["term", "idf", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch["term"].dictionary_encode()
        code = names.indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sums = np.add.reduceat(_rows(batch["v"], dimensions).astype("float64"), first, axis=0)
        terms, idf = names.dictionary.take(pa.array(code[first])).to_pylist(), batch["idf"].to_numpy()[first].tolist()
        if open_ and open_[0] == terms[0]:
            sums[0] += open_[2]
        elif open_:
            yield row([open_[0]], [open_[1]], open_[2][None])
        open_ = terms[-1], idf[-1], sums[-1]
        if len(terms) > 1:
            yield row(terms[:-1], idf[:-1], sums[:-1])
    if open_:
        yield row([open_[0]], [open_[1]], open_[2][None])


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, rounds: int = 1) -> DataFrame:
    """The model of a corpus (id, content): term, idf and v, the components of its direction, whose number is in the metadata of v."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "encoder")
    texts = _texts(docs)
    counted(texts).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    total = float(docs.where("id IS NOT NULL").select("id").distinct().count())
    idf = counts.groupBy("term").agg(F.log((1 + F.lit(total)) / (1 + F.sum("n"))).alias("idf")).withColumn("idf", F.col("idf") + 1)
    idf.withColumn("v", _direction(dimensions, seed)).write.parquet(f"{folder}/idf")
    terms = spark.read.parquet(f"{folder}/idf")
    for step in range(rounds):
        counts.select("b", "term").join(terms, "term").write.parquet(f"{folder}/dictionaries-{step}")
        behind = _behind(spark.read.parquet(f"{folder}/dictionaries-{step}"), texts)
        parts = behind.mapInArrow(partial(_turned_to, dimensions=dimensions, packed=not step), "term string, idf double, v array<float>")
        parts.repartition("term").sortWithinPartitions("term").mapInArrow(partial(_joined, dimensions=dimensions), "term string, idf double, v array<float>").write.parquet(f"{folder}/terms-{step}")
        terms = spark.read.parquet(f"{folder}/terms-{step}")
    # With the Gram matrix G = V D V', the components times V / sqrt(D) are orthonormal.
    gram = np.zeros((dimensions, dimensions))
    # Parts are added in order of their rows, so that the same corpus has the same sum.
    for part in terms.select("v").mapInArrow(partial(_products, dimensions=dimensions), "products array<double>").select("products").orderBy("products").toLocalIterator():
        gram += np.array(part["products"]).reshape(dimensions, dimensions)
    values, vectors = np.linalg.eigh(gram)
    scale = np.divide(1.0, np.sqrt(np.maximum(values, 0)), out=np.zeros(dimensions), where=values > max(values.max(), 0) * 1e-12)
    made = terms.mapInArrow(partial(_turned, turned=vectors * scale), "term string, idf double, v array<float>")
    return made.select("term", "idf", F.col("v").alias("v", metadata={"dimensions": dimensions}))


def _rows(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimensions)


def _products(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """The sums of products of components over a task's terms, one row."""
    total = np.zeros((dimensions, dimensions))
    for batch in batches:
        x = _rows(batch["v"], dimensions).astype("float64")
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["products"])


def _turned(batches: Iterator[pa.RecordBatch], turned: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _rows(batch["v"], len(turned)) @ turned
        yield pa.RecordBatch.from_arrays([batch["term"], batch["idf"], _lists(x, pa.float32())], ["term", "idf", "v"])


def _encoded(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    for _, _, index, idf, v, piece in _by_block(batches, dimensions, False):
        made = [weight @ v[terms].astype("float64") for terms, weight in _weighted(piece["words"].to_pylist(), index, idf)]
        yield pa.RecordBatch.from_arrays([piece["id"], _lists(np.concatenate(made), pa.float64())], ["id", "embedding"])


def encode(docs: DataFrame, model: DataFrame) -> DataFrame:
    """id and embedding (array<double>) of (id, content); a text without a known term is the zero vector."""
    dimensions = model.schema["v"].metadata["dimensions"]
    texts = _texts(docs)
    dictionaries = counted(texts).select("b", "term").join(model, "term")
    return _behind(dictionaries, texts).mapInArrow(partial(_encoded, dimensions=dimensions), f"id {docs.schema['id'].dataType.simpleString()}, embedding array<double>")
