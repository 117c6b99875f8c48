"""Bounded-space online packing of token sequences into fixed windows.

Each partition keeps a fixed number of open windows. A document's ids are cut at whole
windows; its rest goes where it fits best. If it fits nowhere and all windows are open, the
fullest one is closed: filled up with the head of the rest, or, if its gap is smaller than
``least`` ids, as it is. Windows still open at the end of a partition are merged, many
partitions together, into full ones; the last of each merged run is cut at powers of two,
so that it needs no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import token_ids
from lodestrata.llm.common import materialise, small_batches

VOCABULARY, END, SIZE = "word_bpe_49k.json", 2, 4096
OPEN, LEAST, TOGETHER = 32, 8, 4
COLUMNS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Open windows of one partition; closed ones are handed over as rows."""

    def __init__(self, size: int, limit: int, least: int, first_id: int):
        self.size, self.limit, self.least, self.next_id = size, limit, least, first_id
        self.open: list[list] = []  # [used, [piece, ...]], a piece is (doc_id, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, total, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, start, size = len(ids) // 4, 0, self.size
        while total - start >= size:
            self.close([(doc_id, start, ids[4 * start : 4 * (start + size)], total)])
            start += size
        while start < total:
            rest = total - start
            fits = [w for w in self.open if size - w[0] >= rest]
            if fits:
                w = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.limit:
                w = [0, []]
                self.open.append(w)
            else:
                w = max(self.open, key=lambda w: w[0])
                gap = size - w[0]
                if gap >= self.least:
                    w[1].append((doc_id, start, ids[4 * start : 4 * (start + gap)], total))
                    start += gap
                self.open.remove(w)
                self.close(w[1])
                continue
            w[1].append((doc_id, start, ids[4 * start :], total))
            w[0] += rest
            start = total
            if w[0] == size:
                self.open.remove(w)
                self.close(w[1])


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int, size: int, limit: int, least: int) -> Iterator[pa.RecordBatch]:
    encoder, part = token_ids.load(vocabulary), TaskContext.get().partitionId()
    windows = Windows(size, limit, least, part << 32)
    tail, kind = end.to_bytes(4, "little"), pa.int64()

    def out(group: int | None) -> pa.RecordBatch:
        rows, windows.rows = windows.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([group] * len(rows), pa.int64())], [*NAMES, "merge_group"])

    for batch in batches:
        kind = batch["doc_id"].type
        for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.emit(pc.fill_null(batch["text"], "")), strict=True):
            windows.add(doc_id, ids + tail)
        yield out(None)
    for _, pieces in windows.open:
        windows.close(pieces)
    yield out(part // TOGETHER)


def _merge(held: pa.Table, size: int) -> pa.Table:
    """Leftover windows of some partitions, end to end in windows of ``size``; the last is cut at powers of two. Ids of documents pass through untouched."""
    held = held.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    left, rows, origin = pc.sum(held["length"]).as_py(), [], []
    seq = (1 << 61) + (held["merge_group"][0].as_py() << 32)

    def room(left: int) -> int:
        return size if left >= size else 1 << (left.bit_length() - 1)

    target, used = room(left), 0
    for row, (start, ids, total) in enumerate(zip(*(held[c].to_pylist() for c in ("start", "ids", "doc_tokens")), strict=True)):
        at, n = 0, len(ids) // 4
        while at < n:
            take = min(n - at, target - used)
            origin.append(row)
            rows.append((start + at, take, ids[4 * at : 4 * (at + take)], total, seq, used))
            at, used, left = at + take, used + take, left - take
            if used == target and left:
                seq, target, used = seq + 1, room(left), 0
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.table([held["doc_id"].take(pa.array(origin)), *made], NAMES)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, size: int = SIZE, limit: int = OPEN, least: int = LEAST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every id of every document, ``end`` after its last included, lies in exactly one piece.
    A null or empty text is the one id ``end``; null and repeated doc_ids pack like others,
    row by row. Partitions pack on their own, with ``limit`` windows in memory. An empty
    table gives no rows. Of further columns nothing is read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = docs.select("doc_id", "text").mapInArrow(
        partial(_pack, vocabulary=vocabulary, end=end, size=size, limit=limit, least=least), f"doc_id {kind}, {COLUMNS}, merge_group long"
    )
    first = materialise(first, "packed")
    merged = first.where("merge_group IS NOT NULL").groupBy("merge_group").applyInArrow(lambda held: _merge(held, size), f"doc_id {kind}, {COLUMNS}")
    return first.where("merge_group IS NULL").drop("merge_group").unionByName(merged)


def digest(docs: DataFrame) -> DataFrame:
    """The op5 columns of documents."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
