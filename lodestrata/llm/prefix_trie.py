"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; it belongs to its smallest member. What a
conversation owns is a suffix of its path: all nodes deeper than the longest prefix that it
shares with a smaller conversation. So sums over subtrees need no walk: each conversation adds
to every node of its path the tokens of its own occurrences below, less those of the nodes it
owns, and whether it owns a leaf; one group-by of prefixes sums them.

A prefix is known by its depth and the exclusive or of two hashes a turn (128 bits), each of the
turn's place and content, which can be scanned in blocks: conversations are cut where the
sorted table's ranges end, so that one of any length is spread over tasks. Windows mark
owners in two levels, within salted groups of a node's members and then among the first ones of
the groups. Texts move once, to be put in order; after that rows are hashes and counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, spread

#: Conversations of a block share first turns with its first one; how many, at most, is one less than TURNS.
BLOCK, TURNS = 20, 4
#: Ids of a node's ends joined into one piece, at most.
PIECE = 4096
NODE = ["depth", "x1", "x2"]


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, block, place (from 1), c1 and c2 (hashes of role and text) and tokens of every turn.

    Turns follow turn (null first), then role, then text. Blocks are the ranges of the sorted table: a long conversation has several.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = turns.repartitionByRange(spread(turns), *by).sortWithinPartitions(*by)
    content = [F.xxhash64(F.lit(i), "role", "text").alias(f"c{i}") for i in (1, 2)]
    rows = materialise(ranged.select("conv_id", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("no"), *content, n_words(F.col("text")).alias("tokens")), "turns")
    blocks = rows.groupBy("conv_id", "block").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(blocks.select("conv_id", "block", "first", before.alias("before")), ["conv_id", "block"])
    return placed.select("conv_id", "block", (F.col("no") - F.col("first") + F.col("before") + 1).alias("place"), "c1", "c2", "tokens")


def rebuilt(turns: DataFrame, block: int = BLOCK, most: int = TURNS) -> DataFrame:
    """Turns of rebuilt conversations, as ordered_turns() returns them, with a turnless first one of place 0 each.

    With h = crc32(conv_id) % ``most``, the first h turns are those of the conversation conv_id - conv_id % ``block``, as far as it has them.
    """
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % most).cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    head = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < most))
    heads = head.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "c1", "c2", "tokens"))).alias("head"))  # less than ``most`` turns
    convs = convs.join(heads, "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<place:bigint,c1:bigint,c2:bigint,tokens:bigint>>")))
    convs = materialise(convs.withColumn("k", F.size("head").cast("long")), "heads")
    root = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"), F.lit(0).cast("long").alias("tokens")))
    first = convs.select("conv_id", F.lit(-1).alias("block"), F.inline(F.concat(root, "head")))
    # The shift goes to each block of a conversation, which splits a long one here too.
    shift = turns.select("conv_id", "block").distinct().join(convs.select("conv_id", "h", "k"), "conv_id")
    rest = turns.join(shift, ["conv_id", "block"]).where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("k"))
    return first.unionByName(rest.select(*first.columns))


def paths(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, block, depth, x1, x2, p1, p2, tokens, upto, last): each node of each path with its parent, the tokens up to it, and whether the path ends there."""
    mixed = turns.select("conv_id", "block", F.col("place").alias("depth"), "tokens", *[F.when(F.col("place") > 0, F.xxhash64(F.lit(i), "place", "c1", "c2")).otherwise(0).alias(f"m{i}") for i in (1, 2)])
    mixed = materialise(mixed, "rebuilt")
    blocks = mixed.groupBy("conv_id", "block").agg(F.bit_xor("m1").alias("b1"), F.bit_xor("m2").alias("b2"), F.sum("tokens").alias("bt"), F.max("depth").alias("deepest"))
    whole = Window.partitionBy("conv_id").orderBy("block")
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)],
        F.coalesce(F.sum("bt").over(earlier), F.lit(0)).alias("bt"), F.max("deepest").over(Window.partitionBy("conv_id")).alias("deepest"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    rows = mixed.join(carried, ["conv_id", "block"])
    xs = [F.bit_xor(f"m{i}").over(inside).bitwiseXOR(F.col(f"b{i}")).alias(f"x{i}") for i in (1, 2)]
    rows = rows.select("conv_id", "block", "depth", *xs, "m1", "m2", "tokens", (F.sum("tokens").over(inside) + F.col("bt")).alias("upto"), (F.col("depth") == F.col("deepest")).alias("last"))
    return rows.select("conv_id", "block", *NODE, *[F.col(f"x{i}").bitwiseXOR(F.col(f"m{i}")).alias(f"p{i}") for i in (1, 2)], "tokens", "upto", "last")


def owned(rows: DataFrame) -> DataFrame:
    """``rows`` with ``own``: whether the conversation is the smallest member of the node.

    The members of a node are dealt to groups by hash; each group's window finds its smallest, and a second window the smallest of those, at most one a group.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(spread(rows))))
    near = dealt.withColumn("first", F.row_number().over(Window.partitionBy(*NODE, "salt").orderBy("conv_id")) == 1)
    near = materialise(near.drop("salt"), "group-owners")
    firsts = near.where("first").withColumn("own", F.row_number().over(Window.partitionBy(*NODE).orderBy("conv_id")) == 1)
    return firsts.unionByName(near.where("NOT first").withColumn("own", F.lit(False))).drop("first")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node in sorted rows become rows of joined ids, ``PIECE`` at most, under their first id."""
    key, ids, out = None, [], []
    for batch in batches:
        for *node, conv in zip(*[batch[c].to_pylist() for c in (*NODE, "conv_id")], strict=True):
            if ids and (node != key or len(ids) == PIECE):
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = node
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "first", "ids"])
            out = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, ids[0], ",".join(map(str, ids)))], [*NODE, "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's pieces, in order, run through one SHA-256; never joined in memory."""
    key, state, out = None, None, []
    for batch in batches:
        for *node, ids in zip(*[batch[c].to_pylist() for c in (*NODE, "ids")], strict=True):
            if node == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = node, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "ends_sha256"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], [*NODE, "ends_sha256"])


def end_hashes(rows: DataFrame) -> DataFrame:
    """Each node with ends and ``ends_sha256`` of their ascending ids.

    Ids are sorted by ranges that split a node of many ends, and joined there; the node's task reads a row for thousands of ids.
    """
    n, ends = spread(rows), rows.where("last").select(*NODE, "conv_id")
    sorted_ends = ends.repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    node = "depth long, x1 long, x2 long"
    pieces = sorted_ends.mapInArrow(_pieces, f"{node}, first long, ids string")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashes, f"{node}, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of the paths of ``turns`` (as rebuilt() returns them): the op11 columns, and depth, x1 and x2, which name the node."""
    rows = materialise(owned(paths(turns)), "paths")
    mine = rows.where("own")
    children = materialise(mine.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    leaves = mine.where("last").join(children, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    shared = rows.where("NOT own").groupBy("conv_id").agg(F.max("upto").alias("shared_tokens"))
    per_conv = shared.join(leaves, "conv_id", "full")
    sums = rows.select("conv_id", "block").distinct().join(per_conv, "conv_id")
    told = rows.join(sums, ["conv_id", "block"], "left")
    # Tokens of the shared part from this node on: all occurrences below less the nodes owned there.
    gain = F.when(~F.col("own"), F.col("shared_tokens") - F.col("upto") + F.col("tokens")).otherwise(0)
    nodes = told.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"), F.sum(gain).cast("long").alias("saved_tokens")
    )
    nodes = materialise(nodes, "nodes")
    # A node's parent has the same owner, but for the first node that a conversation owns.
    branch = mine.where("depth > 0").select("conv_id", "depth", F.col("x1").alias("n1"), F.col("x2").alias("n2"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), "x1", "x2", F.col("conv_id").alias("parent_conv_id"))
    up = branch.join(parents, NODE).select("depth", F.col("n1").alias("x1"), F.col("n2").alias("x2"), "parent_conv_id")
    whole = nodes.join(up, NODE, "left").join(children, NODE, "left").join(end_hashes(rows), NODE, "left")
    none = F.sha2(F.lit(""), 256)
    return whole.select("conv_id", *NODE, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, as trie() returns them.

    Columns beyond conv_id, turn, role and text are ignored, whatever their names. Rows of
    null conv_id take no part. A null role or text is empty; turns that share a number follow role and
    text, and repeated rows are turns of their own. Texts and conversations may be of any length.
    A conversation left without turns ends at the root. An empty table has no nodes.
    """
    return trie(rebuilt(ordered_turns(conversations)))


def digest(conversations: DataFrame) -> DataFrame:
    """The op11 columns of conversations."""
    return conversation_trie(conversations).drop("x1", "x2")
