"""Stored tables that change: tables merged by key, and the append-only event log.

Both are Parquet below one folder, dealt into buckets by a hash of their key. What a version (a batch) writes lies under its own
partition and counts once its list of buckets is written, last of all; a write that broke off is not seen, and a version that is written
again replaces itself and gives the same rows. One writer at a time; versions are numbers that grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut, hub_join, numbered

#: Buckets of a table; a bucket is what a merge reads and writes, and one task's work.
BUCKETS = 64
#: Events that seal a run. Fixed values.
TERMINAL = ("RUN_COMPLETED", "RUN_ABORTED", "RUN_REJECTED")
#: Longest stored summary, in characters. Fixed value.
SUMMARY = 1000


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def bucket_of(cols: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in cols]), F.lit(buckets)).cast("int")


class Commits:
    """Which buckets each version of a folder wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/commits"

    def add(self, version: int, buckets: list[int]) -> None:
        self.spark.createDataFrame([(b,) for b in buckets], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def all(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "bucket int, version long")
        return self.spark.read.schema("bucket int, version long").parquet(self.path)

    def latest(self, before: int | None = None) -> dict[int, list[int]]:
        """version: the buckets whose newest rows (of versions below `before`) it holds. As many numbers as there are buckets."""
        seen = self.all() if before is None else self.all().where(F.col("version") < before)
        out: dict[int, list[int]] = {}
        for r in seen.groupBy("bucket").agg(F.max("version").alias("version")).collect():
            out.setdefault(r["version"], []).append(r["bucket"])
        return out

    def done(self) -> list[int]:
        return [r["version"] for r in self.all().select("version").distinct().collect()]


def _write(df: DataFrame, path: str, buckets: int) -> None:
    df.repartition(min(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4), "bucket").write.partitionBy("version", "bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


class KeyedTable:
    """A table with one row for each key. A merge joins changes with the buckets that they fall in and writes those buckets anew in
    which a row differs; all others keep their files."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.commits = Commits(spark, path)

    def _rows(self, before: int | None, only: list[int] | None = None) -> DataFrame:
        """The rows of versions below `before`, with their bucket; of the buckets `only`, if given. Other files are not opened."""
        full = T.StructType([*self.schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
        held = {v: [b for b in bs if only is None or b in set(only)] for v, bs in self.commits.latest(before).items()}
        held = {v: bs for v, bs in held.items() if bs}
        if not held:
            return self.spark.createDataFrame([], full).drop("version")
        here = reduce(lambda a, b: a | b, [(F.col("version") == v) & F.col("bucket").isin(bs) for v, bs in held.items()])
        return self.spark.read.schema(full).parquet(f"{self.path}/data").where(here).drop("version")

    def read(self, before: int | None = None) -> DataFrame:
        """The table as it is now, or as it was before a version."""
        return self._rows(before).drop("bucket")

    def merge(self, version: int, changes: DataFrame, sets: dict[str, Column] | None = None, only_matched: bool = False) -> list[int]:
        """Merges changes (the key and any columns of the table, one row for each key) as a version and returns the buckets it wrote.
        A column becomes sets[column], an expression over the old row `o` and the change `n` (either may be absent), else the
        change's where it has that column, else it stays. only_matched: changes without an old row are left out."""
        changes = cut(changes.withColumn("bucket", bucket_of(self.key, self.buckets)))
        touched = sorted(r["bucket"] for r in changes.select("bucket").distinct().collect())
        old = self._rows(version, touched).withColumn("held", F.lit(True))
        new = changes.withColumn("given", F.lit(True))
        same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.key])
        both = old.alias("o").join(new.alias("n"), same, "left" if only_matched else "full_outer")
        given = F.coalesce(F.col("n.given"), F.lit(False))

        def value(f: T.StructField) -> Column:
            if f.name in self.key:
                return F.coalesce(f"o.{f.name}", f"n.{f.name}")
            if sets and f.name in sets:
                return F.when(given, sets[f.name]).otherwise(F.col(f"o.{f.name}"))
            return F.when(given, F.col(f"n.{f.name}")).otherwise(F.col(f"o.{f.name}")) if f.name in changes.columns else F.col(f"o.{f.name}")

        row = [value(f).cast(f.dataType).alias(f.name) for f in self.schema]
        was = F.struct(*[F.col(f"o.{f.name}") for f in self.schema])
        merged = both.select(*row, F.coalesce("o.bucket", "n.bucket").alias("bucket"), (F.col("o.held").isNull() | ~F.struct(*row).eqNullSafe(was)).alias("differs"))
        changed = sorted(r["bucket"] for r in merged.where("differs").select("bucket").distinct().collect())
        if changed:
            _write(merged.where(F.col("bucket").isin(changed)).drop("differs").withColumn("version", F.lit(version).cast("long")), f"{self.path}/data", self.buckets)
        self.commits.add(version, changed)
        return changed


class EventLog:
    """An append-only log of events by run. The last sequence of each run, and whether it is sealed, are kept in a keyed table, so an
    append never reads the events that are there."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.heads = KeyedTable(spark, f"{path}/heads", "run_id string, last long, sealed boolean", ("run_id",), buckets)
        self.commits = Commits(spark, path)

    def _add(self, batch: int, events: DataFrame) -> None:
        own = events.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], bucket_of(("run_id",), self.buckets).alias("bucket"), F.lit(batch).cast("long").alias("version"))
        own = cut(own)
        heads = own.groupBy("run_id").agg(F.max("sequence").cast("long").alias("last"), F.bool_or(F.col("event_type").isin(*TERMINAL)).alias("sealed"))
        own.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket", F.pmod("sequence", F.lit(16))).write.partitionBy("version", "bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/events")
        self.heads.merge(batch, heads, {"last": F.greatest("o.last", "n.last"), "sealed": F.coalesce("o.sealed", F.lit(False)) | F.col("n.sealed")})
        self.commits.add(batch, [r["bucket"] for r in own.select("bucket").distinct().collect()])

    def load(self, batch: int, events: DataFrame) -> None:
        """Adds events as they are, with their sequences: a log from elsewhere."""
        self._add(batch, events)

    def append(self, batch: int, incoming: DataFrame) -> None:
        """Appends incoming (run_id, id, and columns of the log but the sequence) with the next dense sequences of their runs, in
        order of id, and summaries cut to SUMMARY characters. Rows without a run, rows of a sealed run, and those behind a run's
        first sealing event, are refused. The same batch again changes nothing."""
        heads = self.heads.read(before=batch)
        fresh = hub_join(incoming.where(F.col("run_id").isNotNull()), heads, "run_id", "left").where(~F.coalesce("sealed", F.lit(False)))
        ends = fresh.where(F.col("event_type").isin(*TERMINAL)).groupBy("run_id").agg(F.min("id").alias("end"))
        fresh = hub_join(fresh, ends, "run_id", "left").where(F.col("end").isNull() | (F.col("id") <= F.col("end")))
        fresh = numbered(fresh, "run_id", "id").withColumn("sequence", F.coalesce("last", F.lit(-1)) + F.col("at"))
        self._add(batch, fresh.withColumn("summary", F.substring("summary", 1, SUMMARY)))

    def read(self, since: int | None = None) -> DataFrame:
        """The events of all finished batches, or of those from `since` on; their batch is `version`."""
        done = [b for b in self.commits.done() if since is None or b >= since]
        full = T.StructType([*self.schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
        if not done:
            return self.spark.createDataFrame([], full).drop("bucket")
        return self.spark.read.schema(full).parquet(f"{self.path}/events").where(F.col("version").isin(done)).drop("bucket")
