"""Which strings contain which others, by an inverted index of q-grams.

Each string that may be contained is filed under one gram, the rarest of its own among the
containing strings; a containing string looks under each of its grams. What meets there is verified.
A string shorter than q is filed under itself, so containing strings also look under their
shorter pieces. No pair is compared that shares nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of a gram.
Q = 3


def grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` neighbouring characters, none of a shorter text."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    shifted = F.arrays_zip(*[F.slice(letters, F.lit(i + 1), F.greatest(F.size(letters) - (size - 1), F.lit(0))).alias(f"c{i}") for i in range(size)])
    return F.array_distinct(F.transform(shifted, lambda z: F.concat(*[z[f"c{i}"] for i in range(size)])))


def containing(wholes: DataFrame, parts: DataFrame, q: int = Q) -> DataFrame:
    """Distinct pairs (whole, part) in which the first contains the second.

    The tables have a column of strings, ``whole`` and ``part``; nulls and empty parts are left
    out, since an empty one is in every string. Of equal strings one is compared. A gram
    that many strings share is one key of a join, which Spark splits where it is skewed.
    """
    wholes, parts = wholes.where("whole IS NOT NULL").distinct(), parts.where("part != ''").distinct()
    posted = wholes.select("whole", F.explode(F.flatten(F.array(*[grams(F.col("whole"), n) for n in range(1, q + 1)]))).alias("gram"))
    often = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    own = F.when(F.length("part") < q, F.array("part")).otherwise(grams(F.col("part"), q))
    asked = parts.select("part", own.alias("own")).select("part", F.size("own").alias("n"), F.explode("own").alias("gram"))
    # A part with a gram that no whole has is in none.
    filed = asked.join(often, "gram").groupBy("part").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"), F.count(F.lit(1)).alias("found"), F.max("n").alias("n")).where("found = n")
    return posted.join(filed.select("part", "gram"), "gram").where(F.contains("whole", "part")).select("whole", "part")
