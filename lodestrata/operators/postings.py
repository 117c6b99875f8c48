"""Text search by an inverted index: postings with their impact, block maxima, and exact top-k that skips blocks.

A posting is (term, block, id, impact): what the term adds to the document's score, a whole
number by the BM25 formula. A block is a stretch of ids; a second, small table has the greatest
impact of each term in each block. A query's terms are joined with the maxima first, which
bounds its score in every block. The blocks of the greatest bounds are scored, the k-th best score there
is a floor for the answer, and only blocks whose bound reaches the floor are scored further.
The result is that of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import keyword_tokens
from lodestrata.operators.lookup import small
from lodestrata.session import shared_folder

#: The two parameters of BM25, and the scale of impacts.
K1, B, SCALE = 1.2, 0.75, 1000
#: Ids of a block, and blocks a query scores first.
BLOCK_IDS, FIRST = 1024, 4


@dataclass
class PostingsIndex:
    """Tables below one folder: postings, maxima (term, block, most) and ceilings (term, ceiling), the most a term can add to any score."""

    postings: DataFrame
    maxima: DataFrame
    ceilings: DataFrame


def open_index(spark: SparkSession, folder: str) -> PostingsIndex:
    """The index that build() has written to a folder."""
    return PostingsIndex(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "maxima", "ceilings")))


def impact(often: Column, rows: float, tf: Column, length: Column, mean: float) -> Column:
    """What a term of ``tf`` occurrences in a text of ``length`` tokens adds; ``often`` is the number of the ``rows`` texts that have it."""
    return F.floor(F.log(1 + F.lit(rows) / often) * SCALE * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean))))


def terms_of(queries: DataFrame) -> DataFrame:
    """query_id and each distinct term of (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(keyword_tokens(F.coalesce("query", F.lit(""))))).alias("term"))


def build(docs: DataFrame, folder: str | None = None, block_ids: int = BLOCK_IDS, terms: DataFrame | None = None) -> PostingsIndex:
    """Index (id, content). ``id`` is a whole number; rows without one are left out, and rows that share one are one text. Null texts have no terms.

    ``terms`` (term) are those that will be asked for: every text is read and measured whole, but only their
    postings are kept, so that other words are not shuffled. Queries of these terms have the scores of the full index.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "postings")
    texts = docs.where("id IS NOT NULL").select("id", keyword_tokens(F.coalesce("content", F.lit(""))).alias("words"))
    each = texts.select("id", F.size("words").cast("long").alias("length"), "words")
    # Lengths travel with the words; only ids that rows share are summed apart.
    repeated = small(texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    each.join(repeated, "id", "left_semi").groupBy("id").agg(F.sum("length").alias("whole")).write.parquet(f"{folder}/shared")
    whole = each.join(small(spark.read.parquet(f"{folder}/shared")), "id", "left").withColumn("length", F.coalesce("whole", "length"))
    # The null behind the words of each text gives every id one row without a term.
    tokens = whole.select("id", "length", F.explode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("word"))
    if terms is None:
        named = tokens.withColumn("term", F.col("word"))
    else:
        wanted = small(terms.select(F.col("term").alias("word"), F.col("term")).distinct())
        named = tokens.join(wanted, "word", "left")
    # Words that are not asked for are counted together, under no term.
    named.groupBy("id", "length", "term").agg(F.count("word").alias("tf")).write.parquet(f"{folder}/words")
    counted = spark.read.parquet(f"{folder}/words")
    rows, mean = counted.where("term IS NULL").agg(F.count(F.lit(1)).cast("double"), F.coalesce(F.avg(F.col("length").cast("double")), F.lit(0.0))).first()
    counts = counted.where("term IS NOT NULL")
    often = counts.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("often"))
    often.select("term", "often", F.floor(F.log(1 + F.lit(rows) / F.col("often")) * SCALE * (K1 + 1)).alias("ceiling")).write.parquet(f"{folder}/ceilings")
    ceilings = spark.read.parquet(f"{folder}/ceilings")
    made = impact(F.col("often"), rows, F.col("tf"), F.col("length"), mean or 1.0)
    posted = counts.join(small(ceilings.select("term", "often")), "term").select("term", F.floor(F.col("id") / block_ids).alias("block"), "id", made.alias("impact"))
    posted.write.parquet(f"{folder}/postings")
    spark.read.parquet(f"{folder}/postings").groupBy("term", "block").agg(F.max("impact").alias("most")).write.parquet(f"{folder}/maxima")
    return open_index(spark, folder)


def _share() -> Column:
    """The score in thousandths of ``most``, cut to a whole thousandth."""
    return F.expr("score * 1000 DIV most") / 1000


def scores(index: PostingsIndex, queries: DataFrame) -> DataFrame:
    """query_id, id, score and share of every document that has a term of the query (query_id, query)."""
    known = terms_of(queries).join(index.ceilings, "term").select("query_id", "term", "ceiling")
    most = small(known.groupBy("query_id").agg(F.sum("ceiling").alias("most")))
    summed = index.postings.join(small(known), "term").groupBy("query_id", "id").agg(F.sum("impact").alias("score"))
    return summed.join(most, "query_id").select("query_id", "id", "score", _share().alias("share"))


def _scored(wanted: DataFrame, index: PostingsIndex) -> DataFrame:
    """Scores of (query_id, block, term): all documents of these blocks that have one of the terms."""
    return wanted.join(index.postings, ["term", "block"]).groupBy("query_id", "block", "id").agg(F.sum("impact").alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(index: PostingsIndex, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """query_id, id, score, share and rank of the ``k`` best documents of each query (query_id, query); ties go to the smaller id.

    ``share`` is the score in thousandths of the most that the query's known terms can add, cut to a whole
    thousandth. Documents without a term of the query are no results; queries without terms have none.
    """
    spark = queries.sparkSession
    folder = shared_folder(spark, "search")
    known = terms_of(queries).join(index.ceilings, "term").select("query_id", "term", "ceiling")
    known.join(index.maxima, "term").select("query_id", "term", "block", "most").write.parquet(f"{folder}/wanted")
    wanted = spark.read.parquet(f"{folder}/wanted")
    bounds = wanted.groupBy("query_id", "block").agg(F.sum("most").alias("bound"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    bounds.withColumn("turn", order).write.parquet(f"{folder}/bounds")
    bounds = spark.read.parquet(f"{folder}/bounds")
    _scored(small(wanted.join(bounds.where(F.col("turn") <= first), ["query_id", "block"])), index).write.parquet(f"{folder}/first")
    scored = spark.read.parquet(f"{folder}/first")
    floors = _best(scored, k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    reach = bounds.where(F.col("turn") > first).join(floors, "query_id", "left").where(F.coalesce((F.col("n") < k) | (F.col("bound") >= F.col("floor")), F.lit(True)))
    rest = _scored(wanted.join(reach.select("query_id", "block"), ["query_id", "block"]), index)
    most = known.groupBy("query_id").agg(F.sum("ceiling").alias("most"))
    found = _best(scored.unionByName(rest), k).join(most, "query_id")
    return found.select("query_id", "id", "score", _share().alias("share"), "rank")
