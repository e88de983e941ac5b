"""Readers of run logs, code files, lint reports and webhook payloads, and the report writer."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "id string, run_id string, sequence string, timestamp string, event_type string, actor string, actor_role string, phase string, payload_ref string, summary string"
HEADER = "run_id string, repo_id string, environment string, run_policy_id string, started_at string, ended_at string, final_state string, initiated_by string, ledger_version int, immutable boolean"
#: Folders that no corpus is read from. Fixed values.
EXCLUDED = (".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build")


def raw_ledger_events(spark: SparkSession, path: str) -> DataFrame:
    """Every well-formed record of JSONL event logs, sequences as they stand (sequence_text)."""
    raw = spark.read.schema(f"{EVENT}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(path)
    kept = raw.where(F.col("_corrupt").isNull() & F.col("sequence").isNotNull() & F.col("event_type").isNotNull())
    return kept.withColumnRenamed("sequence", "sequence_text").drop("_corrupt")


def ledger_events(spark: SparkSession, path: str) -> DataFrame:
    """The event logs below a folder; blank and malformed records and those without sequence or type are left out, and times that do not parse are null."""
    t = raw_ledger_events(spark, path).withColumn("sequence", F.col("sequence_text").try_cast("int")).withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return t.where(F.col("sequence").isNotNull()).drop("sequence_text")


def ledger_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run headers, one JSON document a file; malformed ones are left out."""
    raw = spark.read.schema(f"{HEADER}, _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(path)
    t = raw.where(F.col("_corrupt").isNull() & F.col("run_id").isNotNull()).drop("_corrupt")
    return t.withColumns({c: F.try_to_timestamp(c) for c in ("started_at", "ended_at")})


def code_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("py", "js", "ts", "jsx", "tsx")) -> DataFrame:
    """(path, content) of the code files below a folder, but for those in EXCLUDED folders; other names are not opened. Bytes that are
    not UTF-8 are dropped (in a file that has such bytes, replacement marks of its own go with them)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    own = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED])))
    text = F.col("content").cast("string")
    return own.select("path", F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))).alias("content"))


def write_files(files: DataFrame, path: str) -> None:
    """Each row (folder, name, content) as a text file of its own below a path, ended by a newline; file_name() finds the name in the file's path.

    On a local file system the tasks write the files themselves, each under another name first, so that none is seen half written and a task that runs
    again puts the same files in place: Spark's writer needs a folder for each file there, starts a process for each to set its mode, and
    moves all of them one by one when the job ends. Any other path is written by Spark."""
    default = files.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    local = re.fullmatch(r"(?:file:(?://)?)?(/[^/].*)", path)
    if not local or not (path.startswith("file:") or default.startswith("file:")):
        files.write.partitionBy("folder", "name").text(path)
        return
    root = local[1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for folder, name, content in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "content")), strict=True):
                if folder not in made:
                    os.makedirs(f"{root}/{folder}", exist_ok=True)
                    made.add(folder)
                begun = f"{root}/{folder}/.{uuid.uuid4().hex}"
                with open(begun, "wb") as out:
                    out.write((content or b"") + b"\n")
                os.replace(begun, f"{root}/{folder}/{name}.txt")
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    os.makedirs(root, exist_ok=True)
    files.select(F.col("folder").cast("string"), "name", F.col("content").cast("binary")).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def file_name(path: str = "path") -> Column:
    """The name of a file of write_files(), from its path."""
    return F.regexp_extract(path, r"(?:name=)?([^/]+)(?:/part-[^/]*|\.txt)$", 1)


def lines(files: DataFrame) -> DataFrame:
    """(.., path, line_no, text): the lines of each file from 1, cut at CRLF, LF or CR; an empty last line is dropped."""
    keys = [c for c in files.columns if c != "content"]
    cut = F.split(F.col("content"), "\r\n|\n|\r")
    cut = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    out = files.select(*keys, F.posexplode(cut).alias("line_no", "text"))
    return out.withColumn("line_no", F.col("line_no") + 1)


def files_from_lines(source_lines: DataFrame) -> DataFrame:
    """(repo_id, path, content): the lines of a file joined by newlines."""
    per = source_lines.groupBy("repo_id", "path").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    return per.select("repo_id", "path", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("content"))


def lint_flat(reports: DataFrame, col: str = "report") -> DataFrame:
    """Issues of flat lint reports, each a JSON array of {filename, location: {row}, code, message}; codes that start with E are errors."""
    item = "array<struct<filename: string, location: struct<row: int>, code: string, message: string>>"
    i = reports.select(F.explode(F.from_json(col, item)).alias("i"))
    return i.select("i.filename", F.col("i.location.row").alias("line"), "i.code", "i.message", F.when(F.col("i.code").startswith("E"), "error").otherwise("warning").alias("severity"))


def lint_nested(reports: DataFrame, col: str = "report") -> DataFrame:
    """Issues of nested lint reports, each a JSON array of {filePath, messages: [{ruleId, line, severity, message}]}; severity 2 is an error."""
    item = "array<struct<filePath: string, messages: array<struct<ruleId: string, line: int, severity: int, message: string>>>>"
    f = reports.select(F.explode(F.from_json(col, item)).alias("f"))
    m = f.select(F.col("f.filePath").alias("filename"), F.explode("f.messages").alias("m"))
    return m.select("filename", F.col("m.line").alias("line"), F.col("m.ruleId").alias("code"), F.col("m.message").alias("message"), F.when(F.col("m.severity") == 2, "error").otherwise("warning").alias("severity"))


def webhooks(deliveries: DataFrame) -> DataFrame:
    """Typed rows of deliveries (delivery_id, event, payload): opened, updated or reopened pull requests with a number, commit
    and repository, and pushes with a commit and repository; one row for each delivery_id."""
    get = lambda p: F.get_json_object("payload", p)
    t = deliveries.select(
        "delivery_id", "event", get("$.action").alias("action"), get("$.repository.full_name").alias("repo_full_name"), get("$.pull_request.number").try_cast("int").alias("pr_number"),
        F.coalesce(get("$.pull_request.head.sha"), get("$.after")).alias("head_sha"), get("$.ref").alias("ref"),
    )
    pr = (F.col("event") == "pull_request") & F.col("action").isin("opened", "synchronize", "reopened") & F.col("pr_number").isNotNull()
    return t.where((pr | (F.col("event") == "push")) & F.col("repo_full_name").isNotNull() & F.col("head_sha").isNotNull()).dropDuplicates(["delivery_id"])


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The runs of JSON run logs, each file an array."""
    return spark.read.schema("run_id string, issues long, fixes long, success boolean, duration double, errors array<struct<message: string>>").option("multiLine", "true").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    report.write.json(path)


def report_json(report: DataFrame, key: str) -> DataFrame:
    return report.select(key, F.to_json(F.struct(*report.columns)).alias("report"))


def as_text(schema: T.StructType, cols: tuple[str, ...]) -> list[Column]:
    return [F.col(c).cast("string") if not isinstance(schema[c].dataType, T.StringType) else F.col(c) for c in cols]
