"""The memory of running conversations: messages arrive in a stream, and batches of ten that have left the recent window are handed on.

A conversation's state is its number of messages and those that no whole batch has taken yet, fewer
than twenty. Each trigger hands on the batches it has changed; the version of a batch with the most messages is the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestrata.operators.conversations import BATCH, RECENT

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "conv_id bigint, batch_no bigint, first_turn bigint, last_turn bigint, n_messages bigint, content string"


class Memory(StatefulProcessor):
    """Numbers messages in order of arrival, within a trigger in order of turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "taken bigint, n bigint")
        self.held = handle.getListState("held", "turn bigint, line string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        fresh = pd.concat(list(rows)).sort_values("turn", kind="stable")
        taken, n = self.counts.get() if self.counts.exists() else (0, 0)
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        held += [(int(turn), ": ".join(x for x in (role, text) if x is not None)) for turn, role, text in zip(fresh["turn"], fresh["role"], fresh["text"], strict=True)]
        n, out = n + len(fresh), []
        while (old := min(n - RECENT - taken, BATCH)) > 0:
            some = held[:old]
            out.append((key[0], taken // BATCH, some[0][0], some[-1][0], old, "\n".join(line for _, line in some)))
            if old < BATCH:
                break
            taken, held = taken + BATCH, held[BATCH:]
        self.counts.update((taken, n))
        self.held.put(held)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    def close(self) -> None:
        pass


def run_batches(messages: DataFrame, output: str, checkpoint: str) -> None:
    """Take what there is of a stream of messages (conv_id, turn, role, text) and append changed batches to a table. A repeated trigger is known by its number."""
    spark = messages.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        found = messages.groupBy("conv_id").transformWithStateInPandas(Memory(), COLUMNS, "Append", "None")
        found.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def last_versions(versions: DataFrame) -> DataFrame:
    """Each batch as it was handed on last."""
    last = versions.groupBy("conv_id", "batch_no").agg(F.max_by(F.struct("first_turn", "last_turn", "n_messages", "content"), "n_messages").alias("v"))
    return last.select("conv_id", "batch_no", "v.*")
