"""Chunks of documents. Sequential folds over one document's text; a small function in Python, Arrow batches around it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import small_batches

# Sizes in characters.
SIZE, OVERLAP, LEAST, MOST, FIXED_SIZE = 500, 50, 100, 1000, 512
#: Bytes of texts whose chunks a worker holds at once, if no single text is larger.
PART = 1 << 20
SENTENCE_END = re.compile(r"""(?<=[.!?])\s+(?=[가-힣A-Z"])""")


def windows(text: str, size: int = FIXED_SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of ``size``, ended early at a sentence mark in their second half; each starts ``overlap`` before the end of the last."""
    out, start = [], 0
    while len(text) - start > size:
        mark = max(text.rfind(m, start, start + size) for m in ".。?!")
        end = mark + 1 if mark > start + size // 2 else start + size
        out.append(text[start:end])
        start = max(end - overlap, start + 1)
    return [*out, text[start:]]


def by_sentences(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, most: int = MOST) -> list[str]:
    """Whole sentences up to ``size``; a chunk begins with the end of the last one, if that had several sentences; sentences above ``most`` are cut."""
    if len(text) < least:
        return [text] if text else []
    out: list[str] = []
    held: list[str] = []
    used = 0
    for s in filter(None, (p.strip() for p in SENTENCE_END.split(text))):
        if len(s) > most:
            if held:
                out.append(" ".join(held))
            out += [s[i : i + size] for i in range(0, len(s), size)]
            held, used = [], 0
        elif held and used + len(s) > size:
            whole = " ".join(held)
            out.append(whole)
            tail = [whole[-overlap:]] if overlap > 0 and len(held) > 1 and len(whole) > overlap else []
            held, used = [*tail, s], sum(map(len, tail)) + len(s)
        else:
            held.append(s)
            used += len(s)
    if held:
        out.append(" ".join(held))
    return [c.strip() for c in out]


def table_rows(text: str, size: int = SIZE, most: int = MOST) -> list[str]:
    """A table whole, or, above ``most``, groups of rows that each repeat the header."""
    if len(text) <= most:
        return [text]
    head: list[str] = []
    rows: list[str] = []
    heading = True
    for line in text.split("\n"):
        rule = line.strip().startswith(("===", "|---"))
        if rule or heading or len(head) < 3:
            head.append(line)
            heading = heading and not rule
        else:
            rows.append(line)
    top, out, held, used = "\n".join(head), [], [], len("\n".join(head))
    for line in rows:
        if held and used + len(line) > size:
            out.append("\n".join([top, *held]))
            held, used = [], len(top)
        held.append(line)
        used += len(line)
    return [*out, "\n".join([top, *held])] if held else out


WAYS = {"windows": windows, "sentences": by_sentences, "table": table_rows}


def _parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Stretches (first, end) of an array of texts with about ``most`` bytes each, a text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, end
        first = end


def _split(batches: Iterator[pa.RecordBatch], way: str, options: dict) -> Iterator[pa.RecordBatch]:
    """Ids pass through untouched. A batch is cut in parts, so that a worker holds the chunks of one part at a time."""
    cut = WAYS[way]
    for batch in batches:
        for first, end in _parts(batch["text"], PART):
            part = batch.slice(first, end - first)
            found = pa.array(([c for c in cut(t, **options) if c.strip()] if t and t.strip() else [] for t in (x.as_py() for x in part["text"])), pa.list_(pa.string()), size=end - first)
            yield pa.RecordBatch.from_arrays([part["doc_id"], found], ["doc_id", "pieces"])


def chunked(docs: DataFrame, way: str = "windows", **options: int) -> DataFrame:
    """Columns doc_id, chunk_index (from 0), total_chunks and content; blank texts give no row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    pieces = docs.select("doc_id", "text").mapInArrow(partial(_split, way=way, options=options), f"doc_id {kind}, pieces array<string>")
    return pieces.select("doc_id", F.size("pieces").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "content")).select("doc_id", "chunk_index", "total_chunks", F.trim("content").alias("content"))


def sections(docs: DataFrame) -> DataFrame:
    """Chunks of documents whose ``sections`` are array<struct<id,type,title,content:array<string>>>: tables by rows, other text by sentences under its title."""
    each = docs.select("file_name", F.posexplode("sections").alias("section_no", "s")).select("file_name", "section_no", "s.*")
    body = F.array_join("content", "\n")
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit("\n\n"), body)).otherwise(body)
    keyed = each.withColumn("doc_id", F.concat_ws("_", "file_name", "id")).withColumn("text", F.when(F.col("type") == "table", body).otherwise(titled))
    found = chunked(keyed.where("type = 'table'"), "table").unionByName(chunked(keyed.where("type != 'table'"), "sentences"))
    about = keyed.select("doc_id", "file_name", F.col("id").alias("section_id"), F.col("type").alias("chunk_type"), "section_no")
    return found.join(about, "doc_id").select(F.concat_ws("_", "doc_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "file_name", "section_id", "section_no", "chunk_type", "chunk_index", "content")
