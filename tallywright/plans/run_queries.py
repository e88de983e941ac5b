"""Queries over runs, issues and fixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import scratch_dir
from ..operators import analytics as an
from ..sources import stores
from .registry import Registry
from .views import AS_OF, Views

REGISTRY = Registry()
add = REGISTRY.add
DAYS = 365
CUT = f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY"
COUNTS = "(SELECT run_id, count(*) AS issues FROM analysis_results GROUP BY run_id)"
OWNED = "(SELECT r.*, a.repository_id FROM analysis_results r JOIN analysis_runs a ON a.id = r.run_id)"

add("an_daily", lambda v: an.daily(v.analysis_runs, v.analysis_results, DAYS, AS_OF), f"""
SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, coalesce(CAST(sum(issues) AS BIGINT), 0) AS issues
FROM analysis_runs a LEFT JOIN {COUNTS} c ON c.run_id = a.id WHERE {CUT} GROUP BY 1""")
add("an_summary", lambda v: an.period_totals(v.analysis_runs, v.analysis_results, DAYS, AS_OF), f"""
WITH own AS (SELECT * FROM analysis_runs WHERE {CUT}), i AS (SELECT * FROM analysis_results WHERE run_id IN (SELECT id FROM own))
SELECT (SELECT count(*) FROM own) AS total_runs, (SELECT count(*) FROM own WHERE status = 'completed') AS completed, (SELECT count(*) FROM own WHERE status = 'failed') AS failed, (SELECT count(*) FROM i) AS issues,
  (SELECT count(*) FROM i WHERE is_fixed = 1) AS fixed, (SELECT count(*) FROM i WHERE is_fixed = 0) AS unfixed, (SELECT count(*) FROM i)::DOUBLE / (SELECT count(*) FROM own) AS issues_per_run""")
add("an_categories", lambda v: an.category_severity(v.analysis_results), "SELECT coalesce(nullif(category, ''), 'unknown') AS category, coalesce(nullif(severity, ''), 'unknown') AS severity, count(*) AS issues FROM analysis_results GROUP BY 1, 2")
add("an_severity", lambda v: an.severities(v.analysis_results), "SELECT " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("high", "medium", "low")) + ", count(*) AS total FROM analysis_results")
add("an_health_score", lambda v: an.health_scores(v.repositories, v.analysis_runs, v.analysis_results, DAYS, AS_OF), f"""
WITH own AS (SELECT * FROM analysis_runs WHERE {CUT}), per AS (SELECT repository_id, count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS completed FROM own GROUP BY 1),
iss AS (SELECT repository_id, count(*) AS issues FROM analysis_results r JOIN own ON own.id = r.run_id GROUP BY 1),
t AS (SELECT p.id AS repository_id, coalesce(runs, 0) AS runs, coalesce(completed, 0) AS completed, coalesce(issues, 0) AS issues FROM repositories p LEFT JOIN per ON per.repository_id = p.id LEFT JOIN iss ON iss.repository_id = p.id),
u AS (SELECT *, CASE WHEN runs > 0 THEN completed / runs * 100 ELSE 0 END AS rate FROM t)
SELECT repository_id, runs, issues, CAST(CASE WHEN runs = 0 THEN 100 ELSE greatest(0, least(100, trunc(rate + 20 - CASE WHEN issues > 0 THEN 20 ELSE 0 END))) END AS INT) AS score,
  CASE WHEN runs > 0 THEN CASE WHEN rate > 70 THEN 'improving' ELSE 'needs_attention' END END AS trend FROM u""")
add("an_top_issues", lambda v: an.top_issues(v.analysis_results, 5), "SELECT issue_code, count(*) AS occurrences FROM analysis_results GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
add("an_runs_list", lambda v: an.list_runs(v.analysis_runs, v.repositories, v.analysis_results, 50, status="completed"), f"""
SELECT a.id, repo_full_name, status, created_at, coalesce(issues, 0) AS issues FROM (SELECT x.*, repo_full_name FROM analysis_runs x JOIN repositories p ON p.id = x.repository_id WHERE status = 'completed' ORDER BY created_at DESC, x.id LIMIT 50) a
LEFT JOIN {COUNTS} c ON c.run_id = a.id""")
add("an_run_detail", lambda v: an.run_details(v.analysis_runs, v.repositories, v.analysis_results).select("id", "repo_full_name", "status", F.size("results").alias("n_results"), F.array_join(F.transform("results", lambda r: r["id"].cast("string")), ",").alias("result_ids")), """
SELECT a.id, repo_full_name, status, coalesce(n, 0) AS n_results, coalesce(ids, '') AS result_ids FROM analysis_runs a LEFT JOIN repositories p ON p.id = a.repository_id
LEFT JOIN (SELECT run_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM analysis_results GROUP BY 1) r ON r.run_id = a.id""")  # fmt: skip
add("an_repo_health", lambda v: an.repository_health(v.repositories, v.analysis_runs), """
WITH per AS (SELECT repository_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  coalesce(sum(epoch(completed_at) - epoch(started_at)) FILTER (WHERE status = 'completed' AND completed_at IS NOT NULL), 0) AS secs FROM analysis_runs GROUP BY 1)
SELECT p.id AS repository_id, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, CASE WHEN coalesce(total, 0) > 0 THEN completed / total * 100 ELSE 0 END AS success_rate,
  CASE WHEN coalesce(completed, 0) > 0 THEN secs / completed ELSE 0 END AS average_seconds FROM repositories p LEFT JOIN per ON per.repository_id = p.id""")
add("an_recent_issues", lambda v: an.recent_issues(v.analysis_runs, v.analysis_results), f"SELECT repository_id, rank, id, issue_code, created_at FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id) AS rank FROM {OWNED}) WHERE rank <= 10")
add("an_issue_summary", lambda v: an.issue_summary(v.analysis_results, 1000, category="safe"), """
SELECT issue_code, count(*) AS issues, count(*) FILTER (WHERE is_fixed = 1) AS fixed, count(DISTINCT file_path) AS files, (count(*) FILTER (WHERE is_fixed = 1))::DOUBLE / count(*) * 100 AS fix_rate
FROM (SELECT * FROM analysis_results WHERE category = 'safe' ORDER BY id LIMIT 1000) GROUP BY 1""")
add("an_by_repository", lambda v: an.by_repository(v.repositories, v.analysis_runs, v.analysis_results), f"""
SELECT repository_id, count(*) AS total, count(*) FILTER (WHERE is_fixed = 1) AS fixed, count(*) FILTER (WHERE is_fixed = 0) AS unfixed, (count(*) FILTER (WHERE is_fixed = 1))::DOUBLE / count(*) * 100 AS fix_rate,
  count(*) FILTER (WHERE category = 'safe') AS safe, count(*) FILTER (WHERE category = 'review') AS review, count(*) FILTER (WHERE category = 'suggestion') AS suggestion, repo_full_name
FROM {OWNED} o JOIN repositories p ON p.id = o.repository_id GROUP BY repository_id, repo_full_name""")
add("an_trending", lambda v: an.trending(v.analysis_results, DAYS, AS_OF, 5), f"""
SELECT issue_code, count(*) AS occurrences, count(*) FILTER (WHERE is_fixed = 1) AS fixed, min_by(category, id) AS category, min_by(severity, id) AS severity FROM analysis_results WHERE {CUT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
add("an_bulk_fix", lambda v: an.bulk_fix(v.analysis_results, ("F401", "E501")).select("id", "is_fixed", "changed"), """
SELECT id, CASE WHEN issue_code IN ('F401', 'E501') AND is_fixed = 0 THEN 1 ELSE is_fixed END AS is_fixed, issue_code IN ('F401', 'E501') AND is_fixed = 0 AS changed FROM analysis_results""")


def _fixed(v: Views):
    """The issues as a stored table, the open ones of two codes marked in it: what is stored then."""
    table = stores.KeyedTable(v.spark, scratch_dir(v.spark), "id long, issue_code string, is_fixed int", ("id",), buckets=16)
    table.merge(0, v.analysis_results.select("id", "issue_code", "is_fixed"))
    table.merge(1, an.bulk_fix(table.read(), ("F401", "E501")).where("changed").select("id", "is_fixed"))
    return table.read()


add("an_bulk_fix_store", _fixed, "SELECT id, issue_code, CASE WHEN issue_code IN ('F401', 'E501') AND is_fixed = 0 THEN 1 ELSE is_fixed END AS is_fixed FROM analysis_results")
add("an_status_counts", lambda v: an.status_counts(v.analysis_runs), "SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status NOT IN ('completed', 'failed')) AS in_progress FROM analysis_runs")
add("an_fix_progress", lambda v: an.fix_progress(v.analysis_runs, v.analysis_results), """
SELECT a.id AS run_id, CASE WHEN coalesce(n, 0) > 0 THEN f / n * 100 ELSE 0 END AS fix_percent FROM analysis_runs a LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE is_fixed = 1) AS f FROM analysis_results GROUP BY 1) r ON r.run_id = a.id""")
add("an_fix_status", lambda v: an.fix_status(v.code_fixes), "SELECT ledger_run_id, count(*) FILTER (WHERE status IN ('proposed', 'pending', 'generated')) AS proposed, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("approved", "rejected", "applied", "failed")) + " FROM code_fixes GROUP BY 1")
add("an_result_fixes", lambda v: an.results_with_fixes(v.analysis_results, v.code_fixes), """
SELECT r.id, issue_code, coalesce(n, 0) AS fixes, n IS NOT NULL AS has_fix, s AS first_status FROM analysis_results r LEFT JOIN (SELECT result_id, count(*) AS n, min_by(status, id) AS s FROM code_fixes GROUP BY 1) f ON f.result_id = r.id""")
add("an_activity_feed", lambda v: an.newest_per(v.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("team_id"), "user_id", F.col("event_type").alias("activity"), F.col("ts").alias("created_at")), "team_id", "created_at", "id", 20), """
SELECT * FROM (SELECT event_id AS id, user_id % 10 AS team_id, user_id, event_type AS activity, ts AS created_at, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 20""")  # fmt: skip
add("an_webhook_feed", lambda v: v.ledger_events.orderBy(F.desc("timestamp"), "id").limit(100).select(F.col("id").alias("delivery_id"), "event_type", "timestamp"), "SELECT id AS delivery_id, event_type, timestamp FROM ledger_events ORDER BY timestamp DESC, id LIMIT 100")
LOG = """SELECT run_id, count(*) FILTER (WHERE event_type = 'ISSUE_DETECTED') AS issues, count(*) FILTER (WHERE event_type = 'FIX_APPLIED') AS fixes, count(*) FILTER (WHERE event_type = 'RUN_ABORTED') AS errors,
  epoch_us(max(timestamp) - min(timestamp)) / 1e6 AS duration, count(*) FILTER (WHERE event_type = 'RUN_COMPLETED') > 0 AS success FROM ledger_events GROUP BY run_id"""


def _log(v: Views):
    e = v.ledger_events
    n = lambda t: F.count_if(F.col("event_type") == t)
    return e.groupBy("run_id").agg(
        n("ISSUE_DETECTED").alias("issues"), n("FIX_APPLIED").alias("fixes"), F.collect_list(F.when(F.col("event_type") == "RUN_ABORTED", F.col("summary"))).alias("errors"),
        ((F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))) / 1e6).alias("duration"), (n("RUN_COMPLETED") > 0).alias("success"),
    )


add("an_run_log_stats", lambda v: an.run_log_stats(_log(v)), f"""
SELECT count(*) AS runs, sum(issues)::BIGINT AS issues, sum(fixes)::BIGINT AS fixes, sum(errors)::BIGINT AS errors, round_even(avg(coalesce(duration, 0)), 2) AS average_duration, round_even((count(*) FILTER (WHERE success))::DOUBLE / count(*) * 100, 1) AS success_percent FROM ({LOG})""")
add("src_run_log", lambda v: _run_log(v), f"SELECT run_id, issues, fixes, success, duration, errors FROM ({LOG})")


def _run_log(v: Views):
    from .ledger_queries import written

    log = _log(v).withColumn("errors", F.transform("errors", lambda e: F.struct(e.alias("message"))))
    one = log.repartition("run_id").select(F.concat(F.lit("["), F.to_json(F.struct("*")), F.lit("]")).alias("value"))
    path = written(v, one, "text")
    read = v.spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<run_id: string, issues: bigint, fixes: bigint, success: boolean, duration: double, errors: array<struct<message: string>>>>")).alias("r")).select("r.*")
    return read.withColumn("errors", F.size("errors"))


LANGS = "SELECT file_path, line_number, issue_code, CASE WHEN id % 3 = 0 THEN 'javascript' WHEN id % 3 = 1 THEN '' END AS language FROM analysis_results"
add("an_language", lambda v: an.language_summary(_languages(v)), f"SELECT coalesce(nullif(language, ''), 'python') AS language, count(*) AS issues FROM ({LANGS}) GROUP BY 1")


def _languages(v: Views):
    lang = F.when(F.col("id") % 3 == 0, "javascript").when(F.col("id") % 3 == 1, "")
    t = v.analysis_results.select("id", "file_path", "line_number", "issue_code", lang.alias("language"))
    return an.merge_languages(t.where("id % 2 = 0").drop("id"), t.where("id % 2 = 1").drop("id"))


add("an_detect_language", lambda v: an.detect_languages(v.part.select((F.col("p_partkey") % 97).alias("repo_id"), _part_path())), """
WITH f AS (SELECT p_partkey % 97 AS repo_id, CASE CAST(p_partkey % 97 % 4 AS INT) WHEN 0 THEN 'a.py' WHEN 1 THEN 'b.' || CASE WHEN p_partkey % 2 = 0 THEN 'TS' ELSE 'js' END WHEN 2 THEN 'README.md' ELSE 'Makefile' END AS path FROM part),
e AS (SELECT repo_id, lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) AS x FROM f),
l AS (SELECT DISTINCT repo_id, CASE x WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' END AS language FROM e)
SELECT repo_id, language FROM l WHERE language IS NOT NULL UNION ALL SELECT repo_id, 'python' FROM l GROUP BY repo_id HAVING count(language) = 0""")


def _part_path():
    k = F.col("p_partkey")
    m = k % 97 % 4
    return F.when(m == 0, "a.py").when(m == 1, F.concat(F.lit("b."), F.when(k % 2 == 0, "TS").otherwise("js"))).when(m == 2, "README.md").otherwise("Makefile").alias("path")
