"""A corpus pipeline of five stages, each over all that the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import hyperminhash, packing, pfair, secrets, toxicity
from lodestrata.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go, repeated ones alike; null and empty texts are scored like others. All columns pass through, whatever their names; an empty table stays empty."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the document of the smallest id stays.

    Texts without words, null ones too, and rows of null doc_id are in no group and stay; of rows that share a doc_id all stay or none. An empty table stays empty.
    """
    return hyperminhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; all rows stay, those of null doc_id and repeated ones are changed like others, null texts stay null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix: the files and the rows in them follow its slots.

    Null sources and those without a weight share a group; ties of doc_id are told apart by the whole row. All rows and columns stay.
    """
    return pfair.mix(docs).orderBy("slot", "place").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; null and empty texts are the end token alone, repeated rows are packed each, an empty table gives no piece."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL for the library tokenizer, the sketches and the segments; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        found.write.parquet(f"{home}/{name}")
        docs = spark.read.schema(found.schema).parquet(f"{home}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
