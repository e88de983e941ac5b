"""Stored facts of code: parsed once for each text, whatever files hold it and however often they are given.

Below one folder lie the facts, partitioned by version and kind and keyed by the hash of the text they are of; the hashes that each
version parsed (also of texts that gave no facts); and a keyed table of the files with the hash of their present text. The facts of a
version count once it is committed, and then the files take their new hashes in one step; a version that is written again replaces
itself. One writer at a time; versions are numbers that grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import structure as st
from .stores import BUCKETS, Commits, KeyedTable, exists


class FactStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.files = KeyedTable(spark, f"{path}/files", "repo_id long, path string, sha string", st.KEY, buckets)
        self.commits = Commits(spark, path)

    def _done(self, before: int | None = None) -> list[int]:
        return [v for v in self.commits.done() if before is None or v < before]

    def hashes(self, before: int | None = None) -> DataFrame:
        """(version, sha): the texts that each finished version (of those below `before`) parsed, each once."""
        done = self._done(before)
        if not done:
            return self.spark.createDataFrame([], "version long, sha string")
        return self.spark.read.schema("sha string, version long").parquet(f"{self.path}/hashes").where(F.col("version").isin(done)).select("version", "sha")

    def add(self, version: int, files: DataFrame) -> None:
        """Takes files (repo_id, path, content; one row for each file) as their present texts, and parses those texts that no version
        before has parsed; of equal texts one. Files that are not given stay as they are. Null content counts as empty.

        Which texts are new is decided over hashes and names alone; a text is shuffled only where there are too many new ones to
        send their names to all tasks, and then by its file's name, so that equal texts do not meet in one task."""
        content = F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary"))
        given = files.select(F.col("repo_id").cast("long").alias("repo_id"), "path", content.alias("content"), F.sha2(content, 256).alias("sha"))
        listed = cut(given.select(*st.KEY, "sha"))
        one = F.min(F.struct(*st.KEY)).alias("at")
        new = cut(listed.join(self.hashes(version), "sha", "left_anti").groupBy("sha").agg(one).select("sha", F.col("at.repo_id").alias("at_repo"), F.col("at.path").alias("at_path")))
        if not new.isEmpty():
            same = (F.col("repo_id").eqNullSafe(F.col("at_repo"))) & (F.col("path").eqNullSafe(F.col("at_path")))
            texts = given.join(new.withColumnRenamed("sha", "new_sha"), same).where("sha = new_sha")
            width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            st.parsed(texts.select("sha", "content").repartition(width, "sha"), "sha string").write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/facts/version={version}")
        new.select("sha").write.mode("overwrite").parquet(f"{self.path}/hashes/version={version}")
        self.commits.add(version, [0])
        self.files.merge(version, listed)  # last: a file never has the hash of a text whose facts do not count yet

    def remove(self, version: int, files: DataFrame) -> None:
        """Takes files (repo_id, path) out, by a version of its own. Their facts stay for other files of the same text."""
        gone = files.select(F.col("repo_id").cast("long").alias("repo_id"), "path", F.lit(None).cast("string").alias("sha"))
        self.spark.createDataFrame([], "sha string").write.mode("overwrite").parquet(f"{self.path}/hashes/version={version}")
        self.commits.add(version, [0])
        self.files.merge(version, gone, only_matched=True)

    def read(self) -> DataFrame:
        """Facts of all present files, as structure.facts() gives them. What a metric asks of kinds and columns reaches the scan:
        other kinds' files are not opened."""
        names = [c.split()[0] for c in st.FACT.split(", ")]
        done = self._done()
        if not done or not exists(self.spark, f"{self.path}/facts"):
            return self.spark.createDataFrame([], st.FACT)
        stored = self.spark.read.schema(f"sha string, {st.NODE}, version long").parquet(f"{self.path}/facts").where(F.col("version").isin(done))
        return stored.join(self.files.read(), "sha").select(*names)
