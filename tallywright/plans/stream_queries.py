"""Queries that run the stream operators over the test tables, written as a stream's source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import scratch_dir
from ..operators import reliability
from ..sources import stores
from ..streaming import streams
from .ledger_queries import written
from .metric_queries import COUNTERS
from .registry import Registry
from .views import Views

REGISTRY = Registry()
add = REGISTRY.add
E = ("run_id", "id", "sequence", "event_type")


def _stream(v: Views, df: DataFrame) -> tuple[DataFrame, str]:
    """df as a stream over files, and a folder for its results."""
    path = written(v, df)
    return v.spark.readStream.schema(df.schema).json(path), f"{path.rsplit('/', 1)[0]}/{uuid.uuid4().hex}"


def _drained(v: Views, df: DataFrame, operator, mode: str = "append") -> DataFrame:
    stream, out = _stream(v, df)
    result = operator(stream)
    streams.drain(result, f"{out}/rows", f"{out}/state", mode)
    return v.spark.read.schema(result.schema).parquet(f"{out}/rows").select(*result.columns)


#: A time beyond all others, and the run of the one event that has it: with it the watermark passes all that is waiting.
_END = ("2200-01-01 00:00:00", "~end")


def _out_of_order(v: Views) -> tuple[DataFrame, str]:
    """The run log as a stream whose files come one by one, each run's events in any order over them, and a folder for its results."""
    e = v.ledger_events.select(*E, F.col("timestamp").cast("timestamp").alias("timestamp"))
    path, end = scratch_dir(v.spark), e.limit(1).select(F.lit(_END[1]).alias("run_id"), F.lit(0).cast(e.schema["id"].dataType).alias("id"), F.lit(0).alias("sequence"), F.lit("RUN_COMPLETED").alias("event_type"), F.lit(_END[0]).cast("timestamp").alias("timestamp"))
    for k in range(3):
        e.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k).repartition(1).write.mode("append").json(path)
    end.coalesce(1).write.mode("append").json(path)
    stream = v.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).json(path)
    return stream, scratch_dir(v.spark)


def _watched(v: Views) -> DataFrame:
    stream, out = _out_of_order(v)
    result = streams.watch_invariants(stream, late="3650 days")
    streams.drain(result, f"{out}/rows", f"{out}/state")
    return v.spark.read.schema(result.schema).parquet(f"{out}/rows").select(*result.columns).where(F.col("run_id") != _END[1])


def _tailed(v: Views) -> DataFrame:
    stream, out = _out_of_order(v)
    table = stores.KeyedTable(v.spark, f"{out}/table", streams.TAIL, ("run_id",), buckets=8)
    streams.drain(streams.ledger_tail_live(stream, late="3650 days"), "", f"{out}/state", "update", sink=streams.merge_into(table))
    return table.read().where(F.col("run_id") != _END[1])


def _limited(v: Views) -> DataFrame:
    """The calls in two files, each with calls of all times, and one far ahead of them with which the watermark passes them."""
    path, out, calls = scratch_dir(v.spark), scratch_dir(v.spark), _calls(v)
    for k in range(2):
        calls.where(F.pmod(F.xxhash64("id"), F.lit(2)) == k).coalesce(1).write.mode("append").json(path)
    v.spark.range(1).select(F.lit(_END[1]).alias("key"), F.lit(7e9).alias("at"), F.lit(0).cast("long").alias("id")).coalesce(1).write.mode("append").json(path)
    stream = v.spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).json(path)
    with streams.rocksdb(v.spark):
        streams.drain(streams.rate_limit_live(stream, 3, 86400.0, "3650 days"), f"{out}/rows", f"{out}/state")
    return v.spark.read.schema(streams.DECISION).parquet(f"{out}/rows").select(*[c.split(" ")[0] for c in streams.DECISION.split(", ")]).where(F.col("key") != _END[1])


def _counted(v: Views) -> DataFrame:
    """Counters of reviews, each micro-batch of them added to what is stored."""
    path, out = scratch_dir(v.spark), scratch_dir(v.spark)
    cols = ("repo_full_name", "critical_risks_count", "high_risks_count")
    v.pr_analyses.select(*cols).repartition(3).write.json(path)
    stream = v.spark.readStream.schema(v.pr_analyses.select(*cols).schema).option("maxFilesPerTrigger", 1).json(path)
    names = ("total_prs", "prs_critical", "prs_high")
    table = stores.KeyedTable(v.spark, f"{out}/table", "repo_full_name string, " + ", ".join(f"{n} long" for n in names), ("repo_full_name",), buckets=8)
    plus = {n: F.coalesce(f"o.{n}", F.lit(0)) + F.col(f"n.{n}") for n in names}
    streams.drain(stream, "", f"{out}/state", sink=streams.merge_into(table, plus, reliability.pr_counters))
    return table.read()


def _hooks(v: Views) -> DataFrame:
    return v.orders.select(
        (F.col("o_orderkey") % 5000).cast("string").alias("delivery_id"), F.when(F.col("o_orderkey") % 4 == 0, "push").otherwise("pull_request").alias("event"), F.when(F.col("o_orderkey") % 4 != 0, F.when(F.col("o_orderkey") % 3 == 0, "closed").otherwise("opened")).alias("action"),
        F.format_string("Customer#%09d", F.col("o_custkey")).alias("repo_full_name"), F.when(F.col("o_orderkey") % 13 != 0, F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("sha"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("received_at"),
    )


def _metrics(v: Views) -> DataFrame:
    stream, out = _stream(v, v.pr_analyses.select("repo_full_name"))
    path = f"{out}/rows"
    anew = lambda batch: reliability.pr_counters(v.pr_analyses.join(batch.select("repo_full_name").distinct(), "repo_full_name", "left_semi"))
    streams.drain(stream, path, f"{out}/state", sink=streams.refresh_metrics(anew, path))
    return v.spark.read.parquet(path).drop("batch").distinct()


def _calls(v: Views) -> DataFrame:
    return v.events.select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("event_id").alias("id")).select("key", (F.col("us") / 1e6).alias("at"), "id")


TAIL = "SELECT run_id, count(*) AS event_count, count(*) FILTER (WHERE event_type = 'FIX_APPLIED') AS fixes_count, max(sequence) AS last_sequence, max_by(event_type, (sequence, id)) AS last_event FROM ledger_events GROUP BY 1"
add("sm_ledger_tail", lambda v: _drained(v, v.ledger_events.select(*E), streams.ledger_tail, "complete"), TAIL)
add("sm_ledger_tail_live", _tailed, TAIL)
add("sm_metrics_store", _counted, COUNTERS)
add("sm_webhook_dedup", lambda v: _drained(v, _hooks(v), streams.dedup_deliveries).select("delivery_id"), "SELECT DISTINCT CAST(o_orderkey % 5000 AS VARCHAR) AS delivery_id FROM orders")
add("sm_trigger_runs", lambda v: _drained(v, _hooks(v), lambda s: streams.trigger_runs(s, v.repositories)), """
WITH h AS (SELECT CAST(o_orderkey % 5000 AS VARCHAR) AS delivery_id, printf('Customer#%09d', o_custkey) AS repo_full_name, o_orderkey AS k FROM orders),
j AS (SELECT h.*, CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN 'ignored' WHEN k % 13 = 0 THEN 'missing' WHEN is_enabled THEN 'queued' ELSE 'untracked' END AS s FROM h LEFT JOIN repositories r ON r.repo_full_name = h.repo_full_name)
SELECT delivery_id, repo_full_name, CASE WHEN s IN ('ignored', 'queued') THEN s ELSE 'skipped' END AS status,
  CASE s WHEN 'ignored' THEN 'Action not configured' WHEN 'missing' THEN 'Missing required fields' WHEN 'untracked' THEN 'Repository not tracked or disabled' END AS reason FROM j""")
add("sm_rate_limit", lambda v: streams.rate_limit(_calls(v), 3, 86400.0))
add("sm_rate_limit_stream", lambda v: _drained(v, _calls(v), lambda s: streams.rate_limit_stream(s, 3, 86400.0)))
add("sm_rate_limit_live", _limited)
add("sm_metrics", _metrics, COUNTERS)
add("sm_daily", lambda v: _drained(v, v.analysis_runs.select("id", "status", F.col("created_at").cast("timestamp").alias("created_at")), streams.daily_counts, "complete"), "SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM analysis_runs GROUP BY 1")
_W = "OVER (PARTITION BY run_id ORDER BY sequence, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
add("sm_invariants", _watched, f"""
WITH e AS (SELECT run_id, sequence, event_type, coalesce(max(sequence) {_W}, -1) AS last, coalesce(bool_or(event_type = 'PLAN_APPROVED') {_W}, false) AS approved,
  coalesce(bool_or(event_type IN ('RUN_COMPLETED', 'RUN_ABORTED', 'RUN_REJECTED')) {_W}, false) AS sealed FROM ledger_events)
SELECT run_id, sequence, 'gap' AS kind FROM e WHERE sequence <> last + 1 UNION ALL SELECT run_id, sequence, 'after_end' FROM e WHERE sealed UNION ALL SELECT run_id, sequence, 'early_fix' FROM e WHERE event_type = 'FIX_APPLIED' AND NOT approved""")
