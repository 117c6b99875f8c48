"""Conversation histories: batches to summarise, recent messages, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Messages of a summary and of the recent window.
BATCH, RECENT = 10, 10


def numbered(messages: DataFrame) -> DataFrame:
    """Add ``no`` (from 1, in order of turn) and ``n``, the messages of the conversation (conv_id)."""
    w = Window.partitionBy("conv_id")
    return messages.withColumn("no", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count(F.lit(1)).over(w))


def batches(messages: DataFrame) -> DataFrame:
    """The messages older than the last ten, in batches of ten: conv_id, batch_no, first_turn, last_turn, n_messages, content."""
    old = numbered(messages).where(F.col("no") <= F.col("n") - RECENT).withColumn("batch_no", F.floor((F.col("no") - 1) / BATCH))
    line = F.concat_ws(": ", "role", "text")
    return old.groupBy("conv_id", "batch_no").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n_messages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"),
    )


def recent(messages: DataFrame, fixed: bool = True) -> DataFrame:
    """The messages before the last one that a prompt repeats. As observed (not ``fixed``) the eleventh last is repeated though summarised."""
    back = F.col("n") - F.col("no")
    most = RECENT - 1 if fixed else RECENT
    return numbered(messages).where((back >= 1) & ((back <= most) | (F.col("n") <= BATCH))).drop("no", "n")


def last_question(messages: DataFrame) -> DataFrame:
    """The last user message of each conversation."""
    return messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("turn"))


def latest(messages: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of conversations, the last touched first: conv_id, n_messages, updated_turn."""
    each = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("updated_turn"))
    return each.orderBy(F.desc("updated_turn"), "conv_id").offset(offset).limit(limit)


def owned(messages: DataFrame, conversations: DataFrame, user: str) -> DataFrame:
    """The messages of a user's conversations."""
    return messages.join(conversations.where(F.col("user_id") == user).select("conv_id"), "conv_id", "left_semi")


def encrypted(messages: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``column`` encrypted (AES, GCM) in base 64."""
    return messages.withColumn(column, F.base64(F.aes_encrypt(F.col(column), F.lit(key))))


def decrypted(messages: DataFrame, key: str, column: str = "text") -> DataFrame:
    return messages.withColumn(column, F.aes_decrypt(F.unbase64(F.col(column)), F.lit(key)).cast("string"))
