"""Queries over reliability metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import scratch_dir
from ..operators import reliability as rel
from ..sources import stores
from .registry import Registry
from .views import AS_OF, Views

REGISTRY = Registry()
add = REGISTRY.add
T = f"TIMESTAMP '{AS_OF}'"
ago = lambda n: f"{T} - INTERVAL {n} DAY"
RISKS = "o_orderkey % 4 AS c, o_orderkey % 6 AS h, o_orderkey % 9 AS m, o_orderkey % 5 AS l, (o_orderkey % 11) / 10.0::DOUBLE AS a"
SCORE = "round_even(greatest(0, least(100, 100.0::DOUBLE - c * 10 - h * 5 - m * 2 - l * 0.5::DOUBLE + a * 10)), 2)"
GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


def _even(p: str, q: str, places: int) -> str:
    """p / q of whole numbers (q > 0) to so many places, half to even, in whole numbers: round_even of doubles misses ties."""
    n, d = f"(({p})::HUGEINT * {10 ** places})", f"(({q})::HUGEINT)"
    rest = f"((({n} % {d}) + {d}) % {d})"
    down = f"(({n} - {rest}) // {d})"
    return f"(({down} + CASE WHEN 2 * {rest} > {d} OR (2 * {rest} = {d} AND {down} % 2 <> 0) THEN 1 ELSE 0 END)::DOUBLE / {10 ** places}::DOUBLE)"


def _scored(v: Views):
    k = F.col("o_orderkey")
    return v.orders.select(k.alias("id"), rel.score(k % 4, k % 6, k % 9, k % 5, (k % 11) / F.lit(10.0)).alias("score"))


add("rel_score", _scored, f"SELECT o_orderkey AS id, {SCORE} AS score FROM (SELECT o_orderkey, {RISKS} FROM orders)")
add("rel_grade", lambda v: _scored(v).select("id", rel.grade(F.col("score")).alias("grade")), f"SELECT o_orderkey AS id, {GRADE.format(SCORE)} AS grade FROM (SELECT o_orderkey, {RISKS} FROM orders)")
COUNTERS = "SELECT repo_full_name, count(*) AS total_prs, count(*) FILTER (WHERE critical_risks_count > 0) AS prs_critical, count(*) FILTER (WHERE critical_risks_count = 0 AND high_risks_count > 0) AS prs_high FROM pr_analyses GROUP BY 1"
ROLLUP = f"""SELECT p.id, p.repo_full_name, coalesce(c, 0)::BIGINT AS critical, coalesce(h, 0)::BIGINT AS high, coalesce(m, 0)::BIGINT AS medium, 0::BIGINT AS low FROM repositories p LEFT JOIN (SELECT repo_full_name, sum(critical_risks_count) AS c, sum(high_risks_count) AS h, sum(medium_risks_count) AS m
FROM pr_analyses WHERE status = 'completed' AND completed_at >= {ago(30)} GROUP BY 1) s ON s.repo_full_name = p.repo_full_name"""
FUNNEL = """SELECT p.id, coalesce(n0, 0) AS proposed, coalesce(n1, 0) AS approved, coalesce(n2, 0) AS applied, coalesce(n3, 0) AS failed, CASE WHEN coalesce(n0, 0) > 0 THEN n2 / n0 ELSE 0 END AS adoption_rate, CASE WHEN coalesce(n2 + n3, 0) > 0 THEN n2 / (n2 + n3) ELSE 0 END AS success_rate
FROM repositories p LEFT JOIN (SELECT a.repository_id, count(*) FILTER (WHERE f.status IN ('proposed', 'approved', 'applied')) AS n0, count(*) FILTER (WHERE f.status IN ('approved', 'applied')) AS n1, count(*) FILTER (WHERE f.status = 'applied') AS n2, count(*) FILTER (WHERE f.status = 'failed') AS n3
FROM code_fixes f JOIN analysis_results r ON r.id = f.result_id JOIN analysis_runs a ON a.id = r.run_id GROUP BY 1) s ON s.repository_id = p.id"""
METRICS = f"""WITH t AS (SELECT r.*, f.proposed, f.approved, f.applied, f.failed, f.adoption_rate, f.success_rate, coalesce(total_prs, 0) AS total_prs, coalesce(prs_critical, 0) AS prs_critical, coalesce(prs_high, 0) AS prs_high
FROM ({ROLLUP}) r JOIN ({FUNNEL}) f ON f.id = r.id LEFT JOIN ({COUNTERS}) c ON c.repo_full_name = r.repo_full_name),
s AS (SELECT *, CASE WHEN total_prs = 0 AND proposed + failed = 0 THEN 100 ELSE round_even(greatest(0, least(100, 100.0::DOUBLE - critical * 10 - high * 5 - medium * 2 - low * 0.5::DOUBLE + adoption_rate * 10)), 2) END AS score FROM t)
SELECT *, {GRADE.format('score')} AS grade FROM s"""


def _metrics(v: Views):
    return rel.metrics(v.repositories, v.analysis_runs, v.analysis_results, v.code_fixes, v.pr_analyses, AS_OF, v.risk_snapshots)


add("rel_pr_counters", lambda v: rel.pr_counters(v.pr_analyses), COUNTERS)
add("rel_risk_rollup", lambda v: rel.risk_rollup(v.repositories, v.pr_analyses, AS_OF), ROLLUP)
add("rel_fix_stats", lambda v: rel.fix_funnel(v.repositories, v.analysis_runs, v.analysis_results, v.code_fixes), FUNNEL)
S = "risk_snapshots"
AT = "max_by({}, (created_at, id)) FILTER (WHERE created_at <= " + T + " - INTERVAL {} DAY)"
TREND = "CASE WHEN {1} IS NULL OR {1} = 0 THEN 'stable' WHEN ({0} - {1}) / {1} * 100 > 10 THEN 'increasing' WHEN ({0} - {1}) / {1} * 100 < -10 THEN 'decreasing' ELSE 'stable' END"
add("rel_metrics", _metrics, f"""
WITH m AS ({METRICS}), p AS (SELECT repo_metrics_id, {', '.join(f'{AT.format(c, n)} AS {x}{n}' for c, x in (('reliability_score', 's'), ('total_risks', 'r')) for n in (7, 30))} FROM {S} GROUP BY 1)
SELECT m.*, score - s7 AS score_change_7d, score - s30 AS score_change_30d, {', '.join(TREND.format('(critical + high + medium + low)', f'r{n}') + f' AS risk_trend_{n}d' for n in (7, 30))} FROM m LEFT JOIN p ON p.repo_metrics_id = m.id""")
add("rel_snapshot_fix", lambda v: rel.fix_snapshots(v.code_fixes, v.analysis_results, v.analysis_runs, _metrics(v)), f"""
SELECT f.id AS code_fix_id, a.repository_id, f.created_at, 'fix_applied' AS snapshot_type, critical AS critical_risks, high AS high_risks, medium AS medium_risks, low AS low_risks, critical + high + medium + low AS total_risks, score AS reliability_score
FROM code_fixes f JOIN analysis_results r ON r.id = f.result_id JOIN analysis_runs a ON a.id = r.run_id JOIN ({METRICS}) m ON m.id = a.repository_id WHERE f.status = 'applied'""")
add("rel_asof_change", lambda v: rel.as_of_changes(v.risk_snapshots, AS_OF), f"SELECT repo_metrics_id, {AT.format('reliability_score', 0)} AS score, {AT.format('reliability_score', 0)} - {AT.format('reliability_score', 7)} AS change_7d, {AT.format('reliability_score', 0)} - {AT.format('reliability_score', 30)} AS change_30d FROM {S} GROUP BY 1")
_PAST = " ASOF LEFT JOIN (SELECT repo_metrics_id, created_at, max_by(reliability_score, id) AS s FROM risk_snapshots GROUP BY 1, 2) b{0} ON b{0}.repo_metrics_id = a.repo_metrics_id AND a.at{0} >= b{0}.created_at"
add("rel_asof_snapshots", lambda v: rel.changes_at_snapshots(v.risk_snapshots), f"""
SELECT a.id, a.repo_metrics_id, a.reliability_score AS score, a.reliability_score - b7.s AS change_7d, a.reliability_score - b30.s AS change_30d FROM (SELECT *, created_at - INTERVAL 7 DAY AS at7, created_at - INTERVAL 30 DAY AS at30 FROM {S}) a{_PAST.format(7)}{_PAST.format(30)}""")


def _merged_metrics(v: Views):
    """Counters of the reviews up to a day, then those of the repositories reviewed since merged in: what is stored then."""
    table = stores.KeyedTable(v.spark, scratch_dir(v.spark), "repo_full_name string, total_prs long, prs_critical long, prs_high long", ("repo_full_name",), buckets=8)
    early = v.pr_analyses.where("id % 3 = 0")
    table.merge(0, rel.pr_counters(early))
    table.merge(1, rel.pr_counters(v.pr_analyses.join(v.pr_analyses.where("id % 3 <> 0").select("repo_full_name").distinct(), "repo_full_name", "left_semi")))
    return table.read()


add("rel_metrics_store", _merged_metrics, COUNTERS)
add("rel_risk_trend", lambda v: rel.risk_trends(v.risk_snapshots, AS_OF), f"""SELECT repo_metrics_id, CASE WHEN past IS NULL OR past = 0 THEN 'stable' WHEN (now - past) / past * 100 > 10 THEN 'increasing' WHEN (now - past) / past * 100 < -10 THEN 'decreasing' ELSE 'stable' END AS risk_trend
FROM (SELECT repo_metrics_id, {AT.format('total_risks', 0)} AS now, {AT.format('total_risks', 30)} AS past FROM {S} GROUP BY 1)""")
add("rel_snapshot", lambda v: rel.pr_snapshots(v.pr_analyses), """SELECT id, repo_full_name, completed_at AS created_at, 'pr_analysis' AS snapshot_type, critical_risks_count AS critical_risks, high_risks_count AS high_risks, medium_risks_count AS medium_risks, 0 AS low_risks,
  critical_risks_count + high_risks_count + medium_risks_count AS total_risks FROM pr_analyses WHERE status = 'completed'""")
add("rel_score_trend", lambda v: rel.score_trend(v.risk_snapshots, AS_OF, 90), f"SELECT repo_metrics_id, created_at, reliability_score, id FROM {S} WHERE created_at >= {ago(90)}")
add("rel_risk_series", lambda v: rel.risk_series(v.risk_snapshots, AS_OF, 90), " UNION ALL ".join(f"SELECT repo_metrics_id, id, created_at, '{s}' AS severity, {s}_risks AS risks FROM {S} WHERE created_at >= {ago(90)}" for s in ("critical", "high", "medium", "low")))
add("rel_adoption_now", lambda v: _metrics(v).select("id", F.lit(AS_OF).cast("timestamp").alias("at"), "adoption_rate", "success_rate"), f"SELECT id, {T} AS at, adoption_rate, success_rate FROM ({FUNNEL})")
FIRST, LAST = "min_by({}, (created_at, id))", "max_by({}, (created_at, id))"
VELOCITY = f"""SELECT repo_metrics_id, count(*) AS points, CASE WHEN count(*) >= 2 THEN round_even(({LAST.format('reliability_score')} - {FIRST.format('reliability_score')}) / count(*), 2) ELSE 0 END AS score_velocity,
  CASE WHEN count(*) >= 2 THEN round_even(({FIRST.format('total_risks')} - {LAST.format('total_risks')}) / count(*), 2) ELSE 0 END AS risk_velocity FROM {S} WHERE created_at >= {ago(700)} GROUP BY 1"""
add("rel_velocity", lambda v: rel.velocity(v.risk_snapshots, AS_OF, 700), VELOCITY)
add("rel_forecast", lambda v: rel.forecast(v.risk_snapshots, AS_OF, 700, 30), f"""SELECT x.repo_metrics_id, round_even(greatest(0, least(100, now + score_velocity * 30)), 1) AS forecast, CASE WHEN points < 14 THEN 'low' ELSE 'medium' END AS confidence
FROM ({VELOCITY}) x JOIN (SELECT repo_metrics_id, {LAST.format('reliability_score')} AS now FROM {S} GROUP BY 1) n ON n.repo_metrics_id = x.repo_metrics_id WHERE points >= 7""")
_PERIODS = {1: f"created_at >= {ago(180)}", 0: f"created_at >= {ago(360)} AND created_at < {ago(180)}"}
_WHOLE = {"s": "CAST(round_even(reliability_score * 100, 0) AS BIGINT)", "r": "total_risks"}
_SUMS = ", ".join(f"coalesce(sum({v}) FILTER (WHERE {w}), 0)::HUGEINT AS {c}{i}, greatest(count({v}) FILTER (WHERE {w}), 1)::HUGEINT AS n{c}{i}" for c, v in _WHOLE.items() for i, w in _PERIODS.items())
_COMPARED = ", ".join(
    f"{_even(f'{c}1', f'n{c}1 * {unit}', 1)} AS {name}, {_even(f'{c}0', f'n{c}0 * {unit}', 1)} AS {name}_before, {_even(f'{c}1 * n{c}0 - {c}0 * n{c}1', f'n{c}1 * n{c}0 * {unit}', 1)} AS {name}_change, "
    f"CASE WHEN {c}0 <> 0 THEN {_even(f'({c}1 * n{c}0 - {c}0 * n{c}1) * sign({c}0) * 100', f'abs({c}0) * n{c}1', 1)} ELSE 0 END AS {name}_percent"
    for c, name, unit in (("s", "score", 100), ("r", "risks", 1))
)
add("rel_period_compare", lambda v: rel.period_compare(v.risk_snapshots, AS_OF, 180), f"""
WITH a AS (SELECT repo_metrics_id, {_SUMS}, count(*) FILTER (WHERE {_PERIODS[1]}) AS points, count(*) FILTER (WHERE {_PERIODS[0]}) AS points_before FROM {S} GROUP BY 1)
SELECT repo_metrics_id, points, points_before, {_COMPARED} FROM a""")
add("rel_period_scores", lambda v: rel.period_scores(v.risk_snapshots, "month"), f"""
WITH p AS (SELECT repo_metrics_id, CAST(date_trunc('month', created_at) AS TIMESTAMP) AS period, sum(reliability_score) / count(*) AS score, sum(critical_risks) / count(*) AS critical, sum(high_risks) / count(*) AS high, sum(total_risks) / count(*) AS risks,
  count(*) FILTER (WHERE snapshot_type = 'pr_analysis') AS prs, count(*) FILTER (WHERE snapshot_type = 'fix_applied') AS fixes FROM {S} GROUP BY 1, 2)
SELECT *, score - lag(score) OVER (PARTITION BY repo_metrics_id ORDER BY period) AS change FROM p""")
add("rel_hotspots", lambda v: rel.hotspots(v.analysis_runs, v.analysis_results), """
WITH o AS (SELECT repository_id, file_path, count(*) AS issues, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
  count(*) FILTER (WHERE is_fixed = 1) AS fixes, min(r.created_at) AS first_seen, max(r.created_at) AS last_seen, count(*) FILTER (WHERE category = 'review') AS n_review, count(*) FILTER (WHERE category = 'safe') AS n_safe, count(*) FILTER (WHERE category = 'suggestion') AS n_suggestion
  FROM analysis_results r JOIN analysis_runs a ON a.id = r.run_id GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN n_review = greatest(n_review, n_safe, n_suggestion) THEN 'review' WHEN n_safe = greatest(n_review, n_safe, n_suggestion) THEN 'safe' ELSE 'suggestion' END AS primary_category, critical * 10.0::DOUBLE + high * 5 + medium * 2 + low * 0.5::DOUBLE AS hotspot_score FROM o)
SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY hotspot_score DESC, file_path) AS rank FROM p""")
COUNTS = "SELECT run_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")) + " FROM analysis_results GROUP BY 1"
VERDICT = f"SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'concerning' WHEN medium > 0 THEN 'good' ELSE 'excellent' END AS verdict FROM ({COUNTS})"
add("rel_run_counts", lambda v: rel.run_counts(v.analysis_results), COUNTS)
add("rel_pr_verdict", lambda v: rel.pr_verdicts(v.analysis_results), VERDICT)
add("rel_check_conclusion", lambda v: rel.check_conclusions(v.analysis_results), f"SELECT run_id, CASE verdict WHEN 'critical' THEN 'failure' WHEN 'concerning' THEN 'neutral' ELSE 'success' END AS conclusion FROM ({VERDICT})")
add("rel_pr_top_findings", lambda v: rel.pr_digest(v.analysis_results), """
SELECT run_id, severity, rank, id, substr(issue_code || ' in ' || file_path, 1, CASE severity WHEN 'critical' THEN 200 ELSE 150 END) AS statement, greatest(0, n - CASE severity WHEN 'critical' THEN 5 ELSE 3 END) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, severity ORDER BY id) AS rank, count(*) OVER (PARTITION BY run_id, severity) AS n FROM analysis_results WHERE severity IN ('critical', 'high')) WHERE rank <= CASE severity WHEN 'critical' THEN 5 ELSE 3 END""")


def _edr(v: Views):
    """Reports of runs and, as runs of the fixture are small, of all runs of a repository together."""
    r = v.analysis_results.select("run_id", "issue_code", "is_fixed").union(v.analysis_results.join(v.analysis_runs.select(F.col("id").alias("run_id"), "repository_id"), "run_id").select((-F.col("repository_id")).alias("run_id"), "issue_code", "is_fixed"))
    fixed = F.col("is_fixed") == 1
    r = r.groupBy("run_id").agg(F.count("*").alias("before"), F.count_if(fixed).alias("fixed"), F.array_join(F.array_sort(F.collect_set(F.when(fixed, F.col("issue_code")))), ",").alias("rules"))
    r = r.withColumns({"mode": F.when(F.col("run_id") % 7 == 0, "analyze").otherwise("fix"), "after": F.col("before") - F.col("fixed") + F.when(F.col("run_id") % 5 == 0, F.col("before")).otherwise(0)})
    return rel.decision_reports(r)


add("rel_edr", _edr, f"""
WITH x AS (SELECT run_id, issue_code, is_fixed FROM analysis_results UNION ALL SELECT -repository_id, issue_code, is_fixed FROM analysis_results r JOIN analysis_runs a ON a.id = r.run_id),
r AS (SELECT run_id, count(*) AS before, count(*) FILTER (WHERE is_fixed = 1) AS fixed, coalesce(string_agg(DISTINCT issue_code, ',' ORDER BY issue_code) FILTER (WHERE is_fixed = 1), '') AS rules FROM x GROUP BY 1),
s AS (SELECT *, CASE WHEN run_id % 7 = 0 THEN 'analyze' ELSE 'fix' END AS mode, before - fixed + CASE WHEN run_id % 5 = 0 THEN before ELSE 0 END AS after FROM r)
SELECT *, CASE WHEN mode = 'analyze' THEN 0 ELSE {_even('greatest(0, least(100 * before, 100 * fixed - CASE WHEN after > before THEN 15 * before ELSE 0 END))', '100 * before', 2)} END AS confidence,
  CASE WHEN after > before THEN 'high' WHEN after > 50 THEN 'medium' WHEN fixed < 10 THEN 'low' WHEN fixed < 50 THEN 'medium' ELSE 'high' END AS risk_level,
  CASE WHEN mode = 'analyze' THEN 'Code analysis completed (preview mode)' WHEN fixed = 0 THEN 'No issues were auto-fixed' WHEN after > before THEN 'Fixed ' || fixed || ' issues (regressions detected)' WHEN fixed = 1 THEN 'Fixed 1 code issue' ELSE 'Fixed ' || fixed || ' code issues' END AS title FROM s""")
_before = lambda v: v.analysis_results.where("id % 3 <> 0").select("run_id", "issue_code")
_after = lambda v: v.analysis_results.where("id % 4 <> 0").select("run_id", "issue_code")
add("rel_regressions", lambda v: rel.scan_diff(_before(v), _after(v)), """
WITH n AS (SELECT run_id, issue_code, count(*) FILTER (WHERE id % 3 <> 0) AS b, count(*) FILTER (WHERE id % 4 <> 0) AS a FROM analysis_results WHERE id % 3 <> 0 OR id % 4 <> 0 GROUP BY 1, 2)
SELECT run_id, count(*) FILTER (WHERE b = 0) AS new_codes, count(*) FILTER (WHERE a = 0) AS fixed_codes, (sum(a) - sum(b))::BIGINT AS net, CASE WHEN sum(a) > sum(b) THEN 'warning' ELSE 'ok' END AS status FROM n GROUP BY 1""")
add("rel_code_counts", lambda v: rel.code_counts(_before(v), _after(v)), "SELECT issue_code, count(*) FILTER (WHERE id % 3 <> 0) AS before, count(*) FILTER (WHERE id % 4 <> 0) AS after FROM analysis_results GROUP BY 1")
