"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

A unit (a word, or the beginning of one) has the log-odds of toxic against other labelled
text under Dirichlet priors: a word's prior is the estimate of its five-letter beginning,
whose prior is that of its four-letter beginning, and so on down to the base rate. Units
whose log-odds stand out by their z-score form the model; every other token costs a fixed
drift. One linear scan of a text finds all maximal segments. A segment's score S over m
tokens has by chance the expectation K * m * exp(-lambda * S) (an extreme-value law) with
lambda and K from the texts labelled 0; segments of small expectation are toxic passages.
A logistic curve turns the best segment's normalised score and the number of significant
segments into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, small_batches

TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled rows the model is fitted on, at most, in the order of a hash; rows the curve is fitted on, at most.
LABELLED, CURVE = 100_000, 20_000
BEGINNINGS = (5, 4)
PRIOR, DRIFT, LEAST_Z, LEAST_RATE = 2.0, 0.7, 3.0, 0.5
SIGNIFICANT = 0.01
THRESHOLD = 0.7
#: Distinct units counted in one worker before they are handed on.
HELD = 500_000


@lru_cache(maxsize=60_000)
def units_of(word: str) -> tuple[str, ...]:
    """A word's units from the most special one; beginnings carry a mark that no word has."""
    return (word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n))


def log_odds(toxic: float, other: float, mean: float, base: float) -> tuple[float, float, float]:
    """(posterior rate, log-odds against the base rate) of counts under a prior of mean ``mean``, and the z-score under the base rate's own prior."""
    a, b = toxic + PRIOR * mean, other + PRIOR * (1 - mean)
    c, d = toxic + PRIOR * base, other + PRIOR * (1 - base)
    odds = np.log(base / (1 - base))
    return a / (a + b), float(np.log(a / b) - odds), float((np.log(c / d) - odds) / np.sqrt(1 / c + 1 / d))


@dataclass
class Model:
    """counts: unit -> (number of texts labelled 1 that hold it, of texts labelled 0). Repeats within a text say nothing new."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    base: float = 0.5
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    curve: tuple[float, float, float] = (0.0, 0.0, -20.0)

    def value(self, word: str, left_out: tuple[set[str], int] | None = None) -> float:
        """A token's score; ``left_out`` is a text's own units and label, not to be counted."""
        known = []
        for unit in units_of(word):
            n = self.counts.get(unit)
            if n is not None and left_out is not None:
                own = int(unit in left_out[0])
                n = (n[0] - own, n[1]) if left_out[1] else (n[0], n[1] - own)
            known.append(n)
        mean, best = self.base, None
        for n in reversed(known):
            if n is not None and n[0] + n[1] > 0:
                mean, value, z = log_odds(max(n[0], 0), max(n[1], 0), mean, self.base)
                best = value if z >= LEAST_Z and mean >= LEAST_RATE else None
        return best - DRIFT if best is not None and best > DRIFT else -DRIFT

    def normalised(self, score: float, length: int) -> float:
        """lambda * S - ln(K * m), 0 at least."""
        return max(0.0, self.rate * score - float(np.log(self.scale * max(length, 1))))

    def sql_features(self) -> tuple[Column, Column]:
        """``features`` of the columns scores and length."""
        each = F.transform("scores", lambda s: F.greatest(F.lit(0.0), s * self.rate - F.log(F.greatest("length", F.lit(1)) * self.scale)))
        return F.coalesce(F.array_max(each), F.lit(0.0)), F.log1p(F.size(F.filter(each, lambda x: x > -float(np.log(SIGNIFICANT)))).cast("double"))

    def features(self, segments: list[tuple[float, int, int]], length: int) -> tuple[float, float]:
        """The best segment's normalised score, and the logarithm of the number of significant ones."""
        each = [self.normalised(s, length) for s, _, _ in segments]
        return max(each, default=0.0), float(np.log1p(sum(x > -np.log(SIGNIFICANT) for x in each)))

    def probability(self, best: float, many: float) -> float:
        x = self.curve[0] * best + self.curve[1] * many + self.curve[2]
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def segments(values: list[float]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end): one scan that merges a candidate with earlier ones whose left sum is lower and right sum not higher.

    Each candidate knows the last earlier one of a lower left sum, so that those in between
    are passed over once and the scan is linear.
    """
    found: list[list] = []  # [left sum, right sum, start, end, place of the last earlier candidate of a lower left sum]
    total = 0.0
    for i, v in enumerate(values):
        if v <= 0:
            total += v
            continue
        left, total = total, total + v
        start, j = i, len(found) - 1
        while j >= 0 and found[j][0] >= left:
            j = found[j][4]
        while j >= 0 and found[j][1] < total:
            left, _, start, _, before = found[j]
            del found[j:]
            j = before
        found.append([left, total, start, i + 1, j])
    return [(r - l, a, b) for l, r, a, b, _ in found]


def sparse_segments(places: list[int], values: list[float]) -> list[tuple[float, int, int]]:
    """``segments`` of a text whose tokens all cost DRIFT but for those at ``places``; runs of cost count as one step.

    A sum is worth nothing beyond a drop below every candidate's left end, so candidates
    are then closed: the lists stay short and the scan linear.
    """
    out: list[tuple[float, int, int]] = []
    steps: list[float] = []
    at: list[int] = []
    end, total = 0, 0.0

    def flush() -> None:
        for s, a, b in segments(steps):
            out.append((s, at[a], at[b - 1] + 1))
        steps.clear()
        at.clear()

    for p, v in zip(places, values, strict=True):
        cost = DRIFT * (p - end)
        if steps and total - cost <= 0:
            flush()
            total = 0.0
        elif steps and cost > 0:
            steps.append(-cost)
            at.append(end)
            total -= cost
        steps.append(v)
        at.append(p)
        total += v
        end = p + 1
    flush()
    return out


class _Values(dict):
    """Scores of words as they come up, a bounded number of them."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > HELD:
            self.clear()
        known = self.model.counts
        likely = word in known or any(word[:n] + "*" in known for n in BEGINNINGS)
        self[word] = found = self.model.value(word) if likely else -DRIFT
        return found


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def passages(text: str | None, values: dict[str, float]) -> tuple[list[tuple[float, int, int]], int]:
    """(maximal segments in tokens, number of tokens) of a text."""
    words = tokens_of(text)
    scores = np.fromiter(map(values.__getitem__, words), dtype=np.float64, count=len(words))
    places = np.flatnonzero(scores > 0)
    return sparse_segments(places.tolist(), scores[places].tolist()), len(words)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([c[u] for u in names], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["unit", "other", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            counts[toxic].update({unit for word in set(tokens_of(text)) for unit in units_of(word)})
        if len(counts[0]) + len(counts[1]) > HELD:
            yield out()
    yield out()


def _measure(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Segments of labelled texts under a model that leaves each text's own counts out."""
    general, known = _Values(model), model.counts.keys()
    for batch in batches:
        rows = []
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words = set(tokens_of(text))
            own = {unit for word in words for unit in units_of(word)}
            # A word without a unit in the model scores the same with and without this text.
            values = {w: general[w] if known.isdisjoint(units_of(w)) else model.value(w, (own, toxic)) for w in words}
            found, length = passages(text, values)
            scores = sorted((s for s, _, _ in found), reverse=True)
            rows.append((int(toxic), length, [float(s) for s in scores]))
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.float64()))], ["toxic", "length", "scores"]
        )


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic curve by Newton's rounds; the last column of ``x`` is the constant, which no penalty holds."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(hold)
        w = w + np.linalg.solve(h, x.T @ (y - p) - hold * w)
    return w


def calibrate(model: Model, clean: int, length: np.ndarray, best: np.ndarray) -> Model:
    """Fit lambda and K on texts labelled 0: how many there are, and length and best score of those with a positive token."""
    if len(best) >= 20 and best.std() > 1e-3:
        model.rate = float(np.clip(np.pi / (best.std() * np.sqrt(6)), 0.3, 1.0))
    # Texts without a positive token have a best score of 0; K * m * exp(-lambda * S) has the mean 1 over all clean texts at most.
    sizes = np.maximum(length, 1).astype(float)
    model.scale = float(np.clip(len(best) / max(clean, 1) / np.mean(sizes * np.exp(-model.rate * best)), 1e-4, 1.0)) if len(best) >= 20 else 1e-3
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, curve: int = CURVE) -> Model:
    """A model from at most ``labelled`` rows of ``labels`` that are not held out; the curve from at most ``curve`` of them.

    Rows are taken in the order of a hash of doc_id. Labels that are null, or contradict one
    another for a doc_id, are not used. Without labels of both kinds every score is near 0.
    """
    docs = docs.select("doc_id", "text")
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("high")).where("toxic = high").drop("high")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = F.broadcast(known.orderBy(order, "doc_id").limit(labelled).withColumnRenamed("doc_id", "l_id"))  # at most ``labelled`` short rows
    texts = docs.join(chosen, docs["doc_id"] == F.col("l_id")).select("text", "toxic")
    counts = texts.mapInArrow(_count, "unit string, other long, toxic long").groupBy("unit").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    total = texts.agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count(F.lit(1)).alias("n")).first()
    model = Model()
    if not total["n1"] or total["n1"] == total["n"]:
        return model
    model.base = total["n1"] / total["n"]
    a, b = F.col("toxic") + PRIOR * model.base, F.col("other") + PRIOR * (1 - model.base)
    z = (F.log(a / b) - float(np.log(model.base / (1 - model.base)))) / F.sqrt(1 / a + 1 / b)
    # Units that stand out, or may give a longer unit its prior; they are some of those of the labelled rows, whose number is a parameter.
    model.counts = {r["unit"]: (r["toxic"], r["other"]) for r in counts.where(z >= LEAST_Z / 2).collect()}
    fewer = F.broadcast(known.orderBy(order, "doc_id").limit(curve).withColumnRenamed("doc_id", "l_id"))
    sample = docs.join(fewer, docs["doc_id"] == F.col("l_id")).select("text", "toxic")
    seen = materialise(sample.mapInArrow(partial(_measure, model=model), "toxic int, length long, scores array<double>"), "toxic-scores")
    # Three numbers a row of at most ``curve`` labelled documents come to the driver, never their lists of scores.
    clean = seen.where("toxic = 0").select("length", F.array_max("scores").alias("best")).toArrow()
    held = clean.filter(clean["best"].is_valid())
    calibrate(model, len(clean), np.asarray(held["length"]), np.asarray(held["best"], dtype=float))
    fit = seen.select("toxic", *(c.alias(n) for c, n in zip(model.sql_features(), ("best", "many"), strict=True))).toArrow()
    x = np.column_stack([np.asarray(fit["best"]), np.asarray(fit["many"]), np.ones(len(fit))])
    model.curve = tuple(map(float, logistic(x, np.asarray(fit["toxic"]).astype(float))))
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    values = _Values(model)
    for batch in batches:
        scores, spans = [], []
        for text in batch["text"].to_pylist():
            found, length = passages(text, values)
            scores.append(model.probability(*model.features(found, length)))
            spans.append(
                [{"start": a, "end": b, "score": s, "expected": float(np.exp(-model.normalised(s, length)))} for s, a, b in found if model.normalised(s, length) > -np.log(SIGNIFICANT)]
            )
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array(spans, shape)], ["doc_id", "score", "passages"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, score and passages, one row per input row.

    passages: array<struct<start,end,score,expected>>, the significant segments in tokens.
    A null or empty text has the score of a text without a toxic token. Null and repeated
    doc_ids keep their rows. Further columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = "array<struct<start:bigint,end:bigint,score:double,expected:double>>"
    return docs.select("doc_id", "text").mapInArrow(partial(_score, model=model, kind=None), f"doc_id {kind}, score double, passages {shape}")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op3 columns of documents."""
    small_batches(docs.sparkSession)
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def _keep(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    values = _Values(model)
    for batch in batches:
        fine = []
        for text in batch["text"].to_pylist():
            found, length = passages(text, values)
            fine.append(model.probability(*model.features(found, length)) < THRESHOLD)
        yield batch.filter(pa.array(fine, pa.bool_()))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold, all columns kept."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_keep, model=train(docs, labels)), docs.schema)
