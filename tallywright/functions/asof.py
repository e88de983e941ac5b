"""As-of joins: each row with the latest row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import hub_join


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: Column, right_at: Column, right_order: tuple[str, ...], cols: tuple[str, ...], block: int = 30 * 86_400) -> DataFrame:
    """left with a struct `found` of cols of the latest row of right (by right_at, then right_order) with the same key and right_at <=
    left_at; null where there is none, or where the key or left_at is null.

    Both tables are put in one order of time and the last right row is carried along, in two levels: inside blocks of `block`
    seconds of a key, and from block to block, of which a key has few. So a key with very many rows is carried in many tasks. Left rows that
    repeat stay; times are compared as timestamps, to the microsecond.
    """
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    own = left.select(F.col(key).alias("_key"), us(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_rank"), F.struct("*").alias("_left"))
    rank = F.struct(us(right_at).alias("_t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(right_order)])
    other = right.where(F.col(key).isNotNull() & right_at.isNotNull()).select(F.col(key).alias("_key"), us(right_at).alias("_at"), F.lit(0).alias("_side"), rank.alias("_order"), F.struct(*cols).alias("_row"))
    both = own.drop("_rank").unionByName(other, allowMissingColumns=True).withColumn("_block", F.floor(F.col("_at") / F.lit(block * 1_000_000)))
    inside = Window.partitionBy("_key", "_block").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_here", F.last("_row", ignorenulls=True).over(inside)).where("_side = 1")
    ends = both.groupBy("_key", "_block").agg(F.max(F.when(F.col("_side") == 0, F.struct("_order", "_row"))).alias("_end"))
    past = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    name = F.to_json(F.struct("_key", "_block"))
    carried = ends.select(name.alias("_name"), F.last("_end._row", ignorenulls=True).over(past).alias("_carried"))
    out = hub_join(here.withColumn("_name", name), carried, "_name", "left")
    known = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    return out.select("_left.*", F.when(known, F.coalesce("_here", "_carried")).alias("found"))
