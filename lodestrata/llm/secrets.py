"""Secrets: strong patterns, and weak candidates that count only with their complementary parts.

A credential has parts: an access identifier, a secret and an endpoint. A strong part (a
``password = ...`` assignment, an access key, a long hexadecimal run) is reported alone. A
weak part (a user name, a mixed-case random string, a URL) is reported only if a part of a
complementary role lies within the same scope of a document: an interval join on
(document, bin of offsets), so no document's parts meet in one place. Parts are found whole,
whatever their length; a random string, an encoded blob too, is told by its characters and entropy.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, small_batches

# The patterns of the base kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A hexadecimal run shorter than this fails anyway; looking for longer runs only is faster.
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS = 6, 20

WEAK = {
    "endpoint": re.compile(r"\b(?:https?|jdbc:[a-z]+|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}"),
    "identity": re.compile(r"""(?i)\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})"""),
    "random": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])"),
}
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "endpoint": "endpoint", "identity": "identifier", "random": "secret"}
SCOPE = 400
PART = "struct<kind:string,role:string,start:int,end:int,weak:boolean>"


def entropy(s: str) -> float:
    """Bits per character of a string."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def parts_of(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(kind, role, start, end, weak) of every part, by start, then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX_LONG.finditer(text)]
    found.sort(key=lambda x: (x[1], BASE.index(x[0])))
    out = [(k, ROLE[k], a, b, False) for k, a, b in found]
    starts, ends = [a for _, a, _ in found], list(accumulate((b for _, _, b in found), max))
    weak = []
    for kind, pattern in WEAK.items():
        for m in pattern.finditer(text) if kind != "endpoint" or "://" in text else ():
            if kind == "random" and (entropy(m[0]) < 4 or not re.search("[0-9]", m[0]) or not re.search("[A-Z]", m[0])):
                continue
            # Of the strong parts that start before the end, does the one that reaches farthest overlap?
            before = bisect_left(starts, m.end())
            if not before or ends[before - 1] <= m.start():
                weak.append((kind, ROLE[kind], m.start(), m.end(), True))
    return out + sorted(weak, key=lambda x: (x[2], x[0]))


ARROW_PARTS = pa.list_(pa.struct([("kind", pa.string()), ("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("weak", pa.bool_())]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids pass through untouched."""
    for batch in batches:
        texts = [t or "" for t in batch["text"].to_pylist()]
        keys = [hashlib.md5(t.encode()).hexdigest() for t in texts]
        parts = [[dict(zip(("kind", "role", "start", "end", "weak"), p, strict=True)) for p in parts_of(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(keys, pa.string()), pa.array(parts, ARROW_PARTS)], ["doc_id", "text_key", "parts"])


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Columns doc_id, text_key, spans: array<struct<kind,role,start,end>> by start, then kind; one row per input row.

    ``text_key`` is a hash of the text, so that spans can be joined back to rows that share
    a doc_id. Strong spans always stay; a weak one stays if a part of another role lies at
    most ``scope`` code points away. Null and empty texts give no spans; repeated rows give
    repeated rows; rows of null doc_id are told apart by their texts. Of the other columns
    nothing is read.
    """
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key string, parts array<{PART}>"
    parts = materialise(source.mapInArrow(_extract, schema), "secret-parts")
    # Only documents with a weak part take part in the join.
    each = parts.where(F.exists("parts", lambda p: p["weak"])).dropDuplicates(["doc_id", "text_key"])
    each = each.select("doc_id", "text_key", F.explode("parts").alias("p")).select("doc_id", "text_key", "p.*")
    weak = each.where("weak").withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
    other = each.select(
        "doc_id", "text_key", F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bin"),
    )
    linked = (
        weak.join(
            other,
            weak["doc_id"].eqNullSafe(other["doc_id"]) & (weak["text_key"] == other["text_key"]) & (weak["bin"] == other["bin"])
            & (F.col("role") != F.col("o_role")) & (F.col("o_start") <= F.col("end") + scope) & (F.col("start") <= F.col("o_end") + scope),
            "left_semi",
        )
        .select("doc_id", "text_key", "kind", "role", "start", "end")
        .distinct()
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("kind", "role", "start", "end")).alias("linked"))
        .withColumnsRenamed({"doc_id": "l_id", "text_key": "l_key"})
    )
    strong = F.transform(F.filter("parts", lambda p: ~p["weak"]), lambda p: F.struct(p["kind"].alias("kind"), p["role"].alias("role"), p["start"].alias("start"), p["end"].alias("end")))
    both = F.concat("strong", F.coalesce("linked", F.array()))
    order = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s.alias("span"))))
    return (
        parts.select("doc_id", "text_key", strong.alias("strong"))
        .join(linked, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_key") == F.col("l_key")), "left")
        .select("doc_id", "text_key", F.transform(order, lambda x: x["span"]).alias("spans"))
    )


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLE)), kind)


def _cut(text: str, spans: list[dict], mark: str) -> str:
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], mark]
        at = max(at, span["end"])
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; overlapping spans are merged. All rows stay, those of null doc_id are changed like others.

    A column ``n_chars``, if there, is set to the new length of the changed texts. Only texts with
    spans leave the JVM; the work on one is linear in its length and its spans.
    """
    kept = find_secrets(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"]).withColumnRenamed("doc_id", "s_id")
    # The columns travel as one, so that no name of theirs meets one of the work.
    rows = docs.select(F.struct(*docs.columns).alias("held"), F.col("doc_id").alias("h_id"), F.md5(F.coalesce("text", F.lit(""))).alias("h_key"))
    joined = rows.join(kept, F.col("h_id").eqNullSafe(F.col("s_id")) & (F.col("h_key") == F.col("text_key")), "left")

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([None if t is None else _cut(t, s, mark) for t, s in pairs], pa.string())

    changed = F.col("spans").isNotNull()
    clean = cleaned(F.when(changed, F.col("held")["text"]), "spans")
    out = joined.select("held", changed.alias("changed"), F.coalesce(clean, F.col("held")["text"]).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("held")["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*[(made[c] if c in made else F.col("held")[c]).alias(c) for c in docs.columns])


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def digest(docs: DataFrame) -> DataFrame:
    """The op10 columns of documents."""
    found = find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(_of("spans", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
