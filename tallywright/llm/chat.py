"""Chat formatting: collapse of cumulative snapshots, then rendering. DataFrame functions only.

A conversation is often logged again with each new turn. Every turn prefix has a rolling hash: the exclusive-or of
128 bits of each turn with its position. A conversation whose full hash is a proper prefix of another is anti-joined
away, and of equal conversations the one with the smallest conv_id stays.

Positions, prefix hashes and rendered texts are built in two levels, inside blocks of BLOCK turn numbers and over the
blocks of a conversation, so the turns of a very long conversation are sorted in many tasks. Only its rendered text, one
row, comes together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import hub_join
from .common import written

#: Turn numbers of a block.
BLOCK = 1000


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(c, conv_id, block, at, role, text): turns numbered from 1 within their block in order of turn (nulls first), role and
    text. c is the conversation's id as text that also null has. Null roles and texts count as empty."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("c", F.to_json(F.struct("conv_id"))).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    inside = Window.partitionBy("c", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return t.select("c", "conv_id", "block", F.row_number().over(inside).cast("long").alias("at"), "role", "text")


def turn_prefixes(numbered: DataFrame) -> DataFrame:
    """(c, conv_id, pos, n_turns, a, b): for each turn its position from 1, the number of turns of its conversation, and the two
    64-bit rolling hashes of the prefix that ends there."""
    past = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("c", "block").agg(F.count("*").alias("n"))
    sizes = sizes.select("c", "block", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("c")).alias("n_turns"))
    t = numbered.join(sizes, ["c", "block"]).withColumn("pos", F.col("before") + F.col("at"))
    run = Window.partitionBy("c", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolling = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "pos", "role", "text")).over(run)
    t = written(t.select("c", "conv_id", "block", "pos", "n_turns", rolling(1).alias("x"), rolling(2).alias("y")))
    ends = t.groupBy("c", "block").agg(F.max(F.struct("pos", "x", "y")).alias("last"))
    ends = ends.select("c", "block", *[F.coalesce(F.bit_xor(f"last.{h}").over(past), F.lit(0)).alias(f"past_{h}") for h in "xy"])
    t = t.join(ends, ["c", "block"])
    return t.select("c", "conv_id", "pos", "n_turns", F.col("x").bitwiseXOR(F.col("past_x")).alias("a"), F.col("y").bitwiseXOR(F.col("past_y")).alias("b"))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(c, n_turns): conversations that no longer one starts with, one of each set of equal ones. Equal prefixes are
    grouped first on both sides, so one that is logged very often is one row of the anti-join."""
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "c")).alias("first")
    whole = prefixes.where("pos = n_turns").groupBy("pos", "a", "b").agg(first)
    proper = prefixes.where("pos < n_turns").select("pos", "a", "b").distinct()
    return whole.join(proper, ["pos", "a", "b"], "left_anti").select("first.c", F.col("pos").alias("n_turns"))


def format_chats(turns: DataFrame, start: str = "<|", mid: str = "|>\n", end: str = "<|end|>\n") -> DataFrame:
    """Render the maximal conversations of (conv_id, turn, role, text).

    Returns one row for each kept conversation: conv_id, n_turns, text: start + role + mid + text + end for each turn.
    Turns are ordered by turn (nulls first), role, text; turns that repeat stay. Null roles and texts render as empty,
    very long ones whole (a conversation has to fit in one row, 2 GB). Rows with a null conv_id are one conversation. An
    empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    numbered = written(numbered_turns(turns))
    kept = written(maximal_conversations(written(turn_prefixes(numbered))))
    line = F.concat(F.lit(start), "role", F.lit(mid), "text", F.lit(end))
    joined = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "").alias("text")
    blocks = hub_join(numbered.select("c", "conv_id", "block", "at", line.alias("text")), kept, "c").groupBy("c", "conv_id", "n_turns", "block").agg(joined("at"))
    return blocks.groupBy("c", "conv_id", "n_turns").agg(joined("block")).select("conv_id", "n_turns", "text")
