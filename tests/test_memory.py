"""Streamed batches of long conversations against those of the whole table."""

from __future__ import annotations

from lodestrata.operators import conversations
from lodestrata.streaming import incremental, memory


def test_memory(spark, tmp_path):
    """Conversations of 1 to 47 messages, in four arrivals of uneven length; a conversation rests and goes on."""
    rows = [(c, t, ("user", "assistant")[t % 2] if t != 4 else None, f"message {t} of {c}") for c, n in ((1, 1), (2, 10), (3, 11), (4, 20), (5, 21), (6, 47)) for t in range(n)]
    home = f"file://{tmp_path}"
    for step, (low, high) in enumerate(((0, 2), (2, 13), (13, 14), (14, 99))):
        part = [r for r in rows if low <= r[1] < high]
        spark.createDataFrame(part, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{home}/in/step={step}")
        arriving = incremental.new_files(spark, f"{home}/in", "conv_id bigint, turn bigint, role string, text string, step int", "parquet")
        memory.run_batches(arriving.drop("step"), f"{home}/out", f"{home}/state")
    got = memory.last_versions(spark.read.schema(memory.COLUMNS).parquet(f"{home}/out"))
    want = conversations.batches(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    columns = ["conv_id", "batch_no", "first_turn", "last_turn", "n_messages", "content"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.count() == 8
