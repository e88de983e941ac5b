"""The folder that all executors share, cutting of lineage there, and joins with keys that hold very many rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys that hub_join() treats as hubs, at most; and rows of a hub, at least.
HUBS, HUB_ROWS = 512, 64
#: Rows of a key on one side of a cell of cell_join(), about.
CELL = 4096


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new temporary folder on a local master (tests), an error on any other."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    return found


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/tallywright/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there, lost executors do not lose it, its columns are read
    one by one, and Spark knows its size (a checkpoint keeps the product of the sizes of all joins before it)."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hub_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left.join(right, key, how), how being inner, left, left_semi or left_anti, where right has one row at most for each key.
    The HUBS most frequent keys of left, each of which would send its rows to one task, meet a broadcast of their rows of
    right, which are as many at most; no other key has more than a HUBS-th of the rows. left is read three times."""
    most = left.groupBy(key).count().where(F.col("count") > HUB_ROWS).orderBy(F.desc("count"), key).limit(HUBS)
    hubs = [r[key] for r in most.collect() if r[key] is not None]
    if not hubs:
        return left.join(right, key, how)
    hub = F.coalesce(F.col(key).isin(hubs), F.lit(False))
    return left.where(~hub).join(right.where(~hub), key, how).unionByName(left.where(hub).join(F.broadcast(right.where(hub)), key, how))


def cell_join(left: DataFrame, right: DataFrame, key: str, *spread: str, cell: int = CELL, right_cell: int | None = None, tasks: int | None = None) -> DataFrame:
    """left.join(right, key) where both sides may hold very many rows of a key: the rows of such a key are dealt by a hash of `spread`
    (one column of left, one of right) into strips of about `cell` rows (right: right_cell, else cell), and each pair of strips is a
    task's key of its own, so that no task gives more than about their product for one of them. Both sides are read several times.
    With `tasks` both sides are dealt to that many, whatever their size, for a join that gives much more than it reads."""
    a, b = spread
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    strips = lambda c, n: F.ceil(F.col(c) / n).cast("int").alias(c)
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    other = right_cell or cell
    wide = cut(count(left, "_a").join(count(right, "_b"), key).where((F.col("_a") > cell) | (F.col("_b") > other)).select(key, strips("_a", cell), strips("_b", other)))
    if wide.isEmpty():
        return dealt(left, key).join(dealt(right, key), key)
    one = lambda df: hub_join(df, wide, key, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_a", "_b")})
    own = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_left = one(left).withColumn("_x", own(a, "_a")).withColumn("_y", every("_b")).drop("_a", "_b")
    dealt_right = one(right).withColumn("_y", own(b, "_b")).withColumn("_x", every("_a")).drop("_a", "_b")
    keys = [key, "_x", "_y"]
    return dealt(dealt_left, *keys).join(dealt(dealt_right, *keys), keys).drop("_x", "_y")


def numbered(df: DataFrame, key: str, *order: str, name: str = "at") -> DataFrame:
    """df with the place of each row within its key, from 1 (long). Rows are dealt by ranges of key and order, so a key with very
    many rows is numbered in many tasks: inside each range, then by the sizes of the ranges before it."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(width, key, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    past = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    out = inside.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_key", "_p", "_before")
