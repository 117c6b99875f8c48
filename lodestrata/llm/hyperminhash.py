"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

A document is the set of its shingles. Every shingle's hash falls into one of BANDS * ROWS
buckets; of each bucket only the least hash is kept, and of that only the count of its
leading zeros and the first mantissa bits: one 16-bit register. Buckets that no hash fell
into borrow the register of the first filled bucket in an order of their own (densification),
so that each register agrees with the probability of the Jaccard similarity and a band is
as selective for a short text as for a long one. Bands of registers propose pairs, the sizes
of the sets and a collision-corrected estimate of the similarity drop the hopeless ones, and
the whole shingle sets decide the rest.

Rows with the same words in the same order form one class and are compared once. Members of a band's group are
linked to one centre a block, and centres to the centre before, so no text has many
partners. Groups that this leaves in several components are then compared whole, in blocks
of sketches; of these comparisons only the clusters of promising texts go on, never their
pairs, and the texts of a cluster are compared whole, again in blocks, bounded in bytes. So every pair that
shares a band is in one component already, or tested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.llm.common import components, materialise, roots, small_batches

#: Words of a shingle and the link threshold, in hundredths, of the general operator.
WORDS, PERCENT = 5, 80
BANDS, ROWS = 48, 6
#: Pairs whose estimate is lower than the threshold by so many standard errors are dropped.
ERRORS = 6.0
#: Members of a band's group to a centre, and texts to a block; sketches to a block; characters of text to a block, if no single text is longer.
BLOCK, SKETCHES, CHARACTERS = 256, 1024, 4_000_000
MANTISSA = 10
EMPTY = 0xFFFF
#: Characters of text hashed at once, and word hashes kept, in one worker.
AT_ONCE, KEPT = 1_000_000, 150_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes methods do just that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, words: int) -> set:
    """The set itself: tuples of ``words`` words, or all words as one if they are fewer."""
    w = words_of(text)
    if len(w) < words:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(words)), strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(each: list[list[bytes]], words: int, cache: dict) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text, given by its words."""
    sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
    total = int(sizes.sum())
    flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(each)), dtype=np.uint64, count=total)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(total - words + 1, 0), dtype=np.uint64)
        for i in range(words):
            rolled = _mix(rolled + flat[i : i + len(rolled)] + np.uint64(0x9E3779B97F4A7C15 + i))
        out, at = [], 0
        for n in sizes.tolist():
            if n >= words:
                out.append(np.unique(rolled[at : at + n - words + 1]))
            elif n:
                one = np.zeros(1, dtype=np.uint64)
                for i in range(n):
                    one = _mix(one + flat[at + i] + np.uint64(0x9E3779B97F4A7C15 + i))
                out.append(_mix(one + np.uint64(n)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += n
    return out


def registers(hashes: list[np.ndarray], count: int) -> np.ndarray:
    """HyperMinHash registers, one row a set: leading zeros of a bucket's least hash, then its mantissa bits; EMPTY where no hash fell."""
    sizes = [len(h) for h in hashes]
    flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        flat = _mix(flat ^ np.uint64(0xD6E8FEB86659FD93))
    bucket = ((flat >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    low = (flat & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5
    least = np.full(len(hashes) * count, np.inf)
    np.minimum.at(least, np.repeat(np.arange(len(hashes)), sizes) * count + bucket.astype(np.int64), low)
    filled = np.isfinite(least)
    fraction, exponent = np.frexp(np.where(filled, least, 1.0))
    zeros = 32 - exponent
    mantissa = ((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    return np.where(filled, (zeros << MANTISSA) | mantissa, EMPTY).astype("<u2").reshape(len(hashes), count)


def lenders(count: int) -> np.ndarray:
    """For each register an order of all registers, the same in every process; empty ones borrow from the first filled one."""
    return np.argsort(np.random.default_rng(11).random((count, count)), axis=1)


def densified(found: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Registers with the empty ones filled by borrowing; rows without any stay empty."""
    out = found.copy()
    rows, cols = np.nonzero((found == EMPTY) & (found != EMPTY).any(1)[:, None])
    turn = 0
    while len(rows):
        lent = found[rows, order[cols, turn]]
        there = lent != EMPTY
        out[rows[there], cols[there]] = lent[there]
        rows, cols, turn = rows[~there], cols[~there], turn + 1
    return out


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > AT_ONCE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sketch(batches: Iterator[pa.RecordBatch], words: int, count: int) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    for batch in batches:
        texts = batch["text"].to_pylist()
        for a, b in _slices(texts):
            each = [words_of(t) for t in texts[a:b]]
            hashes = shingle_hashes(each, words, cache)
            found = registers(hashes, count)
            same = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in each]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(a, b - a), pa.array([len(h) for h in hashes], pa.int64()), pa.array(same, pa.binary()), pa.array([r.tobytes() for r in found], pa.binary())],
                ["doc_id", "n_shingles", "same", "sketch"],
            )


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Columns doc_id, n_shingles, same (a digest of the words in their order) and sketch, one row per input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_sketch, words=words, count=BANDS * ROWS), f"doc_id {kind}, n_shingles long, same binary, sketch binary")


def chance(n: np.ndarray, m: np.ndarray, count: int) -> np.ndarray:
    """Probability that the registers of a bucket agree although their hashes differ, for sets of ``n`` and ``m`` shingles in ``count`` buckets.

    Both least hashes must lie in the same octave (equal leading zeros), then in the same of its 2**MANTISSA parts.
    """
    octave = 2.0 ** -np.arange(33)
    share = [np.exp(-x[..., None] / count * octave[1:]) - np.exp(-x[..., None] / count * octave[:-1]) for x in (n, m)]
    filled = [1 - np.exp(-x / count) for x in (n, m)]
    return (share[0] * share[1]).sum(-1) / (filled[0] * filled[1]) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, registers filled in either) of sketches of sets of ``n`` and ``m`` shingles, row by row; equal registers that chance explains are taken off."""
    filled = (a != EMPTY) | (b != EMPTY)
    held = np.maximum(filled.sum(-1), 1)
    same = ((a == b) & filled).sum(-1) / held
    lucky = chance(np.asarray(n, dtype=float), np.asarray(m, dtype=float), a.shape[-1])
    return np.clip((same - lucky) / (1 - lucky), 0, 1), held


def promising(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether the sizes, which decide exactly, and the estimate leave a link possible, the estimate)."""
    found, held = estimate(a, b, n, m)
    least = percent / 100 - ERRORS * np.sqrt(percent / 100 * (1 - percent / 100) / held)
    return (found >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)), found


def _grid(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), -1)


def _screen(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            sizes = (np.asarray(batch["a_n"]), np.asarray(batch["b_n"]))
            keep = promising(_grid(batch["a_sketch"]), _grid(batch["b_sketch"]), *sizes, percent)[0]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))


def _sides(row: dict, percent: int) -> tuple[list[dict], list[dict], np.ndarray, np.ndarray]:
    """The members of a block pair, and for each pair of them whether they lie in different components and may be linked, and their estimate."""
    left, right = row["left"], row["right"]
    grids = [np.frombuffer(b"".join(x["sketch"] for x in m), dtype="<u2").reshape(len(m), -1) for m in (left, right)]
    groups = [np.array([x["component_id"] for x in m]) for m in (left, right)]
    sizes = [np.array([x["n"] for x in m], dtype=np.int64) for m in (left, right)]
    found = np.zeros((len(left), len(right)))
    likely = np.zeros((len(left), len(right)), dtype=bool)
    for at in range(len(left)):
        n = sizes[0][at]
        apart = np.flatnonzero((groups[1] != groups[0][at]) & (100 * np.minimum(sizes[1], n) >= percent * np.maximum(sizes[1], n)))
        if len(apart):
            likely[at, apart], found[at, apart] = promising(grids[1][apart], grids[0][at][None, :], sizes[1][apart], np.broadcast_to(n, len(apart)), percent)
    return left, right, likely, found


def _cluster(batches: Iterator[pa.RecordBatch], percent: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """For each member of a block pair with a promising partner the smallest id of its local cluster."""
    for batch in batches:
        for row in batch.to_pylist():
            left, right, likely, _ = _sides(row, percent)
            if not likely.any():
                continue
            ids, place = np.unique(np.array([x["id"] for x in left + right]), return_inverse=True)
            joined = np.zeros((len(ids), len(ids)), dtype=bool)
            i, j = np.nonzero(likely)
            joined[place[: len(left)][i], place[len(left) :][j]] = True
            joined |= joined.T
            some = np.flatnonzero(joined.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some].tolist(), kind), pa.array(ids[roots(joined)[some]].tolist(), kind)], ["a", "b"])


def _link(batches: Iterator[pa.RecordBatch], words: int, percent: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Links between whole texts of a block pair that join components, the most alike first; texts that are joined by then are not compared."""
    for batch in batches:
        for row in batch.to_pylist():
            left, right, likely, found = _sides(row, percent)
            parent: dict = {}

            def root(x: object, parent: dict = parent) -> object:
                while (y := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent.setdefault(y, y)
                return x

            i, j = np.nonzero(likely)
            sets: dict = {}
            links = []
            for k in np.argsort(-found[i, j], kind="stable"):
                x, y = left[i[k]], right[j[k]]
                c, d = root(x["component_id"]), root(y["component_id"])
                if c == d:
                    continue
                for side, m in ((0, i[k]), (1, j[k])):
                    if (side, m) not in sets:
                        sets[side, m] = shingle_set((left, right)[side][m]["text"], words)
                s, t = sets[0, i[k]], sets[1, j[k]]
                both = len(s & t)
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    parent[c] = d
                    links.append((max(x["id"], y["id"]), min(x["id"], y["id"])))
            yield pa.RecordBatch.from_arrays([pa.array([e[n] for e in links], kind) for n in (0, 1)], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], words: int, percent: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by pair; a pair may go on in the next batch."""
    pair, xs, ys, kept = None, [], [], []

    def alike() -> bool:
        for s in (shingle_set(x, words) for x in xs):
            for t in (shingle_set(y, words) for y in ys):
                both = len(s & t)
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    return True
        return False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], kind) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        kept = []
        for a, b, first, text in zip(*(batch[c].to_pylist() for c in ("a", "b", "first", "text")), strict=True):
            if (a, b) != pair:
                if pair is not None and alike():
                    kept.append(pair)
                pair, xs, ys = (a, b), [], []
            (xs if first else ys).append(text)
        yield out()
    kept = [pair] if pair is not None and alike() else []
    yield out()


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of doc_ids those whose whole shingle sets are alike.

    Each document's text goes once to each of its pairs, and the two texts of a pair meet
    under the pair's own key, so a document with many partners burdens no task.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b")
    placed = wanted.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").select("a", "b", (F.col("id") == F.col("a")).alias("first"), "text")
    met = placed.repartition("a", "b").sortWithinPartitions("a", "b")
    kind = pairs.schema["a"].dataType
    name = kind.simpleString()
    return met.mapInArrow(partial(_verify, words=words, percent=percent, kind=to_arrow_type(kind)), f"a {name}, b {name}")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = lenders(BANDS * ROWS)
    for batch in batches:
        if not len(batch):
            continue
        each = densified(_grid(batch["sketch"]), order).astype(np.uint64).reshape(len(batch), BANDS, ROWS)
        with np.errstate(over="ignore"):
            keys = np.broadcast_to(_mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)), each.shape[:2])
            for r in range(ROWS):
                keys = _mix(keys + each[:, :, r] + np.uint64(0x9E3779B97F4A7C15))
        ids = batch["id"].take(pa.array(np.repeat(np.arange(len(batch)), BANDS)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys.reshape(-1).view(np.int64))], ["id", "key"])


def bands(found: DataFrame) -> DataFrame:
    """Columns id and key: a row for each band of a sketch with its empty registers filled."""
    return found.select("id", "sketch").mapInArrow(_bands, f"id {found.schema['id'].dataType.simpleString()}, key long")


def shared_bands(held: DataFrame) -> DataFrame:
    """key, id, n and low (the smallest id) of the bands that several sketches share."""
    each = bands(held)
    groups = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("n > 1")
    return each.join(groups, "key").select("key", "id", "n", "low")


def star_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, that link every member of a band's group to its block's centre, and each centre to the one before."""
    small = shared.where(f"n <= {BLOCK} AND id > low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    large = shared.where(f"n > {BLOCK}").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))).select("key", "block", "id")
    centres = large.groupBy("key", "block").agg(F.min("id").alias("low"))
    members = large.join(centres, ["key", "block"]).where("id > low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    before = F.lag("low").over(Window.partitionBy("key").orderBy("low"))
    line = centres.select(F.col("low").alias("a"), before.alias("b")).where("b IS NOT NULL")
    return small.unionByName(members).unionByName(line).distinct()


def block_pairs(members: DataFrame, group: str, held: list[str], most: int, weight: Column | None = None) -> DataFrame:
    """left and right: blocks of about ``most`` members of a group, or a total ``weight`` of CHARACTERS; all pairs of blocks but those within the group's main component.

    ``members`` has the group, id and component_id; groups of one component are left out.
    Each member goes to its block's pairs where it lies, so that no task holds a group. A pair
    of a block with itself has the same members on both sides.
    """
    weight = F.lit(0) if weight is None else weight
    sizes = members.groupBy(group, "component_id").agg(F.count(F.lit(1)).alias("size"), F.sum(weight).alias("bytes"))
    top = F.max_by(F.struct("component_id", "size", "bytes"), F.struct("size", "component_id")).alias("top")
    several = sizes.groupBy(group).agg(top, F.sum("size").alias("total"), F.sum("bytes").alias("all_bytes")).where("total > top.size")
    blocks = lambda n, b: F.greatest(F.ceil(n / most), F.ceil(b / CHARACTERS), F.lit(1))
    counts = several.select(
        group, F.col("top.component_id").alias("main"), blocks(F.col("top.size"), F.col("top.bytes")).alias("n_main"),
        blocks(F.col("total") - F.col("top.size"), F.col("all_bytes") - F.col("top.bytes")).alias("n_rest"),
    )
    placed = members.join(counts, group).withColumn("is_main", F.col("component_id") == F.col("main"))
    # Blocks of other components come first: 0 .. n_rest - 1; those of the main one follow and are not paired with one another.
    block = F.when(F.col("is_main"), F.col("n_rest") + F.pmod(F.xxhash64("id", F.lit(7)), "n_main")).otherwise(F.pmod(F.xxhash64("id", F.lit(7)), "n_rest"))
    partners = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_main")) - 1)
    dealt = placed.withColumn("block", block.cast("long")).withColumn("partner", F.explode(partners.cast("array<long>")))
    member = F.struct("id", "component_id", *held)
    pairs = dealt.groupBy(group, F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j")).agg(
        F.collect_list(F.when(F.col("block") <= F.col("partner"), member)).alias("left"), F.collect_list(F.when(F.col("block") > F.col("partner"), member)).alias("right")
    )
    return pairs.select("left", F.when(F.col("i") == F.col("j"), F.col("left")).otherwise(F.col("right")).alias("right")).where("size(left) > 0 AND size(right) > 0")


def open_links(shared: DataFrame, held: DataFrame, labels: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that the centres missed: shared: key, id; held: id, n, sketch; labels: id, component_id of the ids linked so far."""
    kind = shared.schema["id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    marked = shared.where("n > 2").select("key", "id").join(labels, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    several = marked.groupBy("key").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo != hi").select("key")
    members = materialise(marked.join(several, "key").join(held, "id").select("key", "id", "component_id", "n", "sketch"), "open-groups")
    near = block_pairs(members, "key", ["n", "sketch"], SKETCHES).mapInArrow(partial(_cluster, percent=percent, kind=arrow), f"a {name}, b {name}")
    clusters = materialise(components(near), "clusters").withColumnRenamed("component_id", "cluster")
    named = clusters.join(labels, "id", "left").withColumn("component_id", F.coalesce("component_id", "id")).join(held, "id")
    whole = named.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").select("cluster", "id", "component_id", "n", "sketch", "text")
    pairs = block_pairs(materialise(whole, "open-texts"), "cluster", ["n", "sketch", "text"], BLOCK, F.length("text"))
    return pairs.mapInArrow(partial(_link, words=words, percent=percent, kind=arrow), f"a {name}, b {name}")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Columns doc_id, n_shingles, component_id and kept, one row per input row.

    Two rows are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle
    sets; component_id is the smallest doc_id reachable by links. A null or empty text, or
    one of white space, has no shingle and no link. Rows that share a doc_id count as one
    document with several texts. A null doc_id takes no part: its component is null and it is kept.
    Bands miss a pair right at 0.8 with a chance of 5e-7. Further columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = materialise(sketches(docs, words), "sketches")
    real = table.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialise(real.groupBy("same").agg(F.min("doc_id").alias("id")), "classes")
    first = real.select(F.col("doc_id").alias("id"), "same", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["id", "same"])
    held = materialise(first.join(classes, ["id", "same"]).select("id", "n", "sketch"), "representatives")
    shared = materialise(shared_bands(held), "bands")
    pairs = materialise(star_pairs(shared), "pairs")
    side = lambda x: held.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    with_sketches = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
    likely = with_sketches.mapInArrow(partial(_screen, percent=percent), f"a {kind}, b {kind}").distinct()
    # A doc_id has one class, unless several rows share it; then their classes belong together.
    members = real.join(classes.withColumnRenamed("id", "class_id"), "same").groupBy("doc_id")
    members = materialise(members.agg(F.min("class_id").alias("class_id"), F.collect_set("class_id").alias("all")), "members")
    together = members.where("size(all) > 1").select(F.explode("all").alias("a"), F.col("class_id").alias("b")).where("a != b")
    links = materialise(verified(likely, docs, words, percent).unionByName(together), "links")
    labels = materialise(components(links), "components")
    more = materialise(open_links(shared, held, labels, docs, words, percent), "open-links")
    if not more.isEmpty():
        labels = materialise(components(links.unionByName(more)), "components")
    places = members.select("doc_id", "class_id").join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    places = places.select("doc_id", F.coalesce("component_id", "class_id").alias("component_id"))
    joined = table.select("doc_id", "n_shingles").join(places, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """The op2 columns of documents: shingles of two words, similarity 0.8."""
    return near_duplicates(docs, words=2)


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one of the smallest doc_id; null doc_ids stay."""
    gone = near_duplicates(docs, words, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
