"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Only Spark SQL expressions run; nothing goes through Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import bound

# The patterns. Groups are possessive and runs start where they can, which
# changes no match but keeps the matcher's time and stack linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: kind -> pattern, cheap test that a text may hold it, score before context.
BASE = {
    "email": (EMAIL, "[A-Za-z0-9._%+-]@[A-Za-z0-9-]", 0.9),
    "ip": (IP, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", 0.6),
    "card": (CARD, r"[0-9](?:[\x20-]?[0-9]){12}", 0.9),
    "phone": (PHONE, r"\+[0-9]", 0.7),
}
MORE = {
    "iban": (IBAN, r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", 0.9),
    "national_id": (NATIONAL, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4),
}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte",
    "national_id": "ssn|social|security|national|tax",
}
WINDOW, LIFT, THRESHOLD = 40, 0.2, 0.5
#: Matches whose offsets are summed in one go.
PART = 128


def located(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches: array<struct<start,end,match,near>>, offsets in code points, end exclusive.

    ``near`` is the match with WINDOW code points on both sides (2 * WINDOW more behind where
    the text has just begun). The pieces between matches and the matches themselves alternate,
    so running sums of their lengths are the offsets. Both an appended array and a substring cost
    what lies before them, so sums and surroundings are taken within PART matches, after the totals of the parts before.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,match:string,near:string>>")

    def step(part: Column) -> Callable[[Column, Column], Column]:
        def add(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["hit"])
            first = F.greatest(begin - part["before"] + part["lead"] + 1 - WINDOW, F.lit(1))
            span = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("match"), F.substr(part["around"], first, F.lit(2 * WINDOW) + F.length(x["hit"])).alias("near"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

        return add

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    def summed(parts: Column) -> Column:
        texts = F.transform(parts, lambda p: F.array_join(F.flatten(F.transform(p, lambda x: F.array(x["gap"], x["hit"]))), ""))
        at = lambda all_, i: F.coalesce(F.get(all_, i), F.lit(""))
        lead = lambda all_, i: F.when(i > 0, F.right(at(all_, i - 1), F.lit(WINDOW))).otherwise("")
        behind = lambda all_, i: F.left(F.concat(at(all_, i + 1), at(all_, i + 2)), F.lit(2 * WINDOW))

        def framed(all_: Column) -> Column:
            each = lambda p, i: F.struct(p.alias("pairs"), F.length(lead(all_, i)).alias("lead"), F.concat(lead(all_, i), at(all_, i), behind(all_, i)).alias("around"))
            return F.transform(parts, each)

        totals = F.transform(texts, lambda t: F.length(t))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(totals, zero, lambda acc, t: F.struct((acc["at"] + t).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        frames = bound(F.concat(texts, F.array(F.element_at(gaps, -1))), framed)
        placed = F.zip_with(frames, before, lambda f, b: F.struct(f["pairs"].alias("pairs"), f["lead"].alias("lead"), f["around"].alias("around"), b.alias("before")))
        return F.flatten(F.transform(placed, lambda part: F.aggregate(part["pairs"], F.struct(part["before"].alias("at"), none.alias("out")), step(part), lambda acc: acc["out"])))

    parts = bound(pairs, lambda all_: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / PART).cast("int")), lambda i: F.slice(all_, i * PART + 1, F.lit(PART))))
    return F.when(text.rlike(hint) & (F.size(hits) > 0), bound(parts, summed)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(digits), "")

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.transform(F.filter(places, lambda c: c != ""), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number passes the mod-97 check (first four characters moved to the end)."""
    turned = F.concat(F.substring(code, 5, 1000), F.substring(code, 1, 4))
    places = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        value = F.when(n >= 65, n - 55).otherwise(n - 48)
        return F.when(value >= 10, (acc * 100 + value) % 97).otherwise((acc * 10 + value) % 97)

    return F.aggregate(places, F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The check behind a proposal of ``kind``."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, "\x20", ""))
    return F.lit(True)


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: array<struct<kind,start,end,match,score>>, by kind (base kinds first), then start.

    Base kinds (email, ip, card, phone) are kept whenever their check passes. The further
    kinds (iban, national_id) are kept if the score, which nearby context words raise,
    reaches the threshold. Null and empty texts give an empty array. Other columns pass
    through; repeated rows each get their own result. Columns named like ``out`` are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.concat(*(_kind_spans(whole, kind) for kind in BASE | MORE)))


def _kind_spans(whole: Column, kind: str) -> Column:
    pattern, hint, base = (BASE | MORE)[kind]

    def scored(s: Column) -> Column:
        lift = F.when(s["near"].rlike(f"(?i)(?:{CONTEXT[kind]})"), LIFT).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
            F.least(F.lit(1.0), F.lit(base) + lift).alias("score"),
        )

    spans = F.transform(F.filter(located(whole, pattern, hint), lambda s: confirmed(kind, s["match"])), scored)
    return F.filter(spans, lambda s: s["score"] >= THRESHOLD) if kind in MORE else spans


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def digest(docs: DataFrame) -> DataFrame:
    """The op9 columns of documents."""
    found = find_personal_data(docs.select("doc_id", "text"), out="found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(_of("found", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans")
    )
