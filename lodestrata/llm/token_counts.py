"""Token counts of whole texts by a compiled transducer; see ``transducer``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import transducer
from lodestrata.llm.common import small_batches

VOCABULARY = "word_bpe_49k.json"
#: Code points of a piece; longer texts are mapped piece by piece.
PIECE = 65_536
LIMIT = 2048


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    machine = transducer.load(vocabulary)
    for batch in batches:
        alone = pc.equal(batch["of"], 1)
        done = iter(machine.counts(batch["piece"].filter(alone)).tolist())
        cut = iter(machine.chunk_maps(batch["piece"].filter(pc.invert(alone)).to_pylist()))
        maps = [("", next(done), "") if a else next(cut) for a in alone.to_pylist()]
        head, count, tail = ([m[i] for m in maps] for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["row"], batch["n_bytes"], batch["no"], pa.array(head, pa.string()), pa.array(count, pa.int64()), pa.array(tail, pa.string())],
            ["doc_id", "row", "n_bytes", "no", "head", "n_tokens", "tail"],
        )


def _scan(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    machine = transducer.load(vocabulary)
    for batch in batches:
        totals = []
        for maps in batch["maps"].to_pylist():
            steps = [(m["head"], m["n_tokens"], m["tail"]) for m in maps]
            while len(steps) > 1:  # the levels of a parallel scan: neighbours in pairs
                steps = [reduce(machine.compose, steps[i : i + 2]) for i in range(0, len(steps), 2)]
            head, count, tail = steps[0]
            totals.append(machine.total(steps[0]) if head or tail else count)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, piece: int = PIECE) -> DataFrame:
    """Columns doc_id, n_bytes (UTF-8) and n_tokens, one row per input row.

    Only the maps of pieces are shuffled, a few numbers and at most two words each, to meet
    the others of their row. A null text counts as empty: 0 bytes, 0 tokens. Null and repeated doc_ids keep their rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("n_bytes", F.octet_length("text").cast("long"))
        .withColumn("of", F.greatest(F.ceil(F.length("text") / piece), F.lit(1)).cast("int"))
        .withColumn("no", F.explode(F.sequence(F.lit(1), F.col("of"))))
    )
    cut = F.when(F.col("of") == 1, F.col("text")).otherwise(F.substr("text", (F.col("no") - 1) * piece + 1, F.lit(piece)))
    maps = pieces.select("doc_id", "row", "n_bytes", "of", "no", cut.alias("piece")).mapInArrow(
        partial(_count, vocabulary=vocabulary),
        f"doc_id {kind}, row long, n_bytes long, no int, head string, n_tokens long, tail string",
    )
    ordered = maps.groupBy("doc_id", "row", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("no", "head", "n_tokens", "tail"))).alias("maps"))
    return ordered.mapInArrow(partial(_scan, vocabulary=vocabulary), f"doc_id {kind}, n_bytes long, n_tokens long")


def digest(docs: DataFrame) -> DataFrame:
    """The op6 columns of documents."""
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
