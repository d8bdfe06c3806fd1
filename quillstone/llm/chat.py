"""Chat formatting with cumulative-snapshot collapse.

A log that stores a conversation after each turn holds every prefix of it. Each conversation gets
rolling hashes of its turn prefixes; one whose full hash is a proper prefix of a longer one is
dropped by an anti-join, of equal ones the first stays, and what is left is rendered.

Hashes of turns are tied to their position and combined by XOR, so prefixes are running XORs. They
are taken in two steps, within blocks of turn numbers and over the blocks, so that a conversation of
any length is spread over tasks; rendered parts are bounded in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tagged(name: str) -> Column:
    """A value that tells null from any text."""
    return F.coalesce(F.concat(F.lit("v"), F.col(name)), F.lit("n"))


def positioned(turns: DataFrame, block_turns: int) -> DataFrame:
    """Turns with their position ``pos`` from 0 in the order of (turn, role, text)."""
    block = F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("long")
    rows = turns.withColumn("block", block)
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    own = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    return (
        rows.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["conv_id", "block"])
        .withColumn("pos", F.col("own") + F.col("before")).drop("own", "before")
    )


def prefix_hashes(turns: DataFrame, block_turns: int) -> DataFrame:
    """(conv_id, len, x1, x2): the rolling hash of each turn prefix; ``turns`` are positioned."""
    hashed = turns.select(
        "conv_id", "pos", F.floor(F.col("pos") / block_turns).alias("part"),
        F.xxhash64("pos", _tagged("role"), _tagged("text")).alias("h1"),
        F.xxhash64(_tagged("text"), _tagged("role"), F.lit("turn"), "pos").alias("h2"),
    )
    sums = hashed.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "conv_id", "part", *(F.coalesce(F.bit_xor(f"b{k}").over(before), F.lit(0)).alias(f"p{k}") for k in (1, 2))
    )
    own = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.withColumns({f"r{k}": F.bit_xor(f"h{k}").over(own) for k in (1, 2)})
    return running.join(sums, ["conv_id", "part"]).select(
        "conv_id", (F.col("pos") + 1).alias("len"), *(F.col(f"r{k}").bitwiseXOR(F.col(f"p{k}")).alias(f"x{k}") for k in (1, 2))
    )


def maximal_conversations(turns: DataFrame, block_turns: int) -> DataFrame:
    """(conv_id, n_turns, n_equal) of conversations that are no proper prefix of another; ``turns`` are positioned."""
    prefixes = prefix_hashes(turns, block_turns)
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("len", "x1", "x2")).alias("w")).select("conv_id", "w.*")
    inner = prefixes.join(whole.select("conv_id", F.col("len").alias("n")), "conv_id").where("len < n")
    inner = inner.select("len", "x1", "x2").distinct()
    return (
        whole.groupBy("len", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
        .join(inner, ["len", "x1", "x2"], "left_anti")
        .select("conv_id", F.col("len").alias("n_turns"), "n_equal")
    )


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, *, block_turns: int = 1024) -> DataFrame:
    """(conv_id, part, n_turns, n_equal, chat): maximal conversations, rendered.

    ``conversations`` has (conv_id, turn, role, text); turns are ordered by (turn, role, text), nulls
    first, and repeated rows count once. ``n_equal`` conversations are the same, the one with the
    smallest conv_id stays. Each part holds up to ``block_turns`` turns, so that parts in their order
    make the chat. Null roles and texts are rendered empty but differ from empty ones. Rows without a
    conv_id are ignored, as are extra columns; an empty table gives an empty result.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text").distinct()
    turns = positioned(turns, block_turns)
    kept = turns.join(maximal_conversations(turns, block_turns), "conv_id")
    parts = kept.groupBy("conv_id", F.floor(F.col("pos") / block_turns).alias("part"), "n_turns", "n_equal").agg(
        F.sort_array(F.collect_list(F.struct("pos", rendered(F.col("role"), F.col("text")).alias("t")))).alias("ts")
    )
    return parts.select("conv_id", "part", "n_turns", "n_equal", F.array_join(F.col("ts.t"), "").alias("chat"))
