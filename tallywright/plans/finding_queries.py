"""Queries over findings, fixes and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import scratch_dir
from ..operators import findings as fd
from ..sources import stores
from .registry import Registry
from .views import AS_OF, Views

REGISTRY = Registry()
add = REGISTRY.add

#: Rules by safety; F401 is in both lists. Fixed values.
RULES = (
    ("F401", "SAFE", 100, "Unused import"), ("F541", "SAFE", 100, "Useless f-string"), ("W291", "SAFE", 100, "Trailing whitespace"), ("W292", "SAFE", 100, "No newline at EOF"), ("W293", "SAFE", 100, "Blank line with whitespace"),
    ("E701", "SAFE", 100, "Multiple statements on one line"), ("E702", "SAFE", 100, "Unnecessary semicolon"), ("E711", "SAFE", 100, "Comparison to None"), ("E712", "SAFE", 100, "Comparison to True/False"),
    ("F841", "RISKY", 50, "Unused variable"), ("E501", "RISKY", 30, "Line too long"), ("C901", "RISKY", 20, "Function too complex"), ("F401", "RISKY", 40, "Unused import with side effects"),
)
#: Analyzers with the smallest plan that includes them. Fixed values.
ANALYZERS = (
    ("architectural", "developer"), ("enhanced_architectural", "team"), ("abstraction", "developer"), ("api_contracts", "developer"), ("god_objects", "developer"), ("performance", "developer"), ("enhanced_performance", "team"),
    ("concurrency", "developer"), ("enhanced_concurrency", "team"), ("security", "developer"), ("test_coverage", "developer"), ("broken_invariants", "developer"), ("configuration", "developer"), ("dependencies", "developer"),
    ("crash_risk", "team"), ("resource_leak", "team"), ("reliability_pattern", "team"), ("scalability_risk", "enterprise"), ("edge_case_logic", "team"),
)
BRIDGE = tuple((p, a) for i, p in enumerate(fd.PLANS) for a, m in ANALYZERS if fd.PLANS.index(m) <= i)
#: Runs a month and repositories of a plan; null is without limit. Fixed values.
LIMITS = (("developer", 100, 3), ("team", 1000, 20), ("enterprise", None, None))
#: Title, description, reason, impact and score of rules. Fixed values.
EXPLAINED = (
    ("F401", "\U0001f5d1\ufe0f Removed unused import", "Module imported but never used in code", "Code that is not referenced cannot affect behavior", "Reduces clutter, improves performance slightly", 100),
    ("F541", "\U0001f4dd Fixed useless f-string", "f-string without placeholders is wasteful", 'Replacing f"text" with "text" has identical behavior', "Removes unnecessary runtime overhead", 100),
    ("W291", "\u2702\ufe0f Removed trailing whitespace", "Extra spaces at end of line", "Whitespace at end has no effect on code", "Improves code consistency and cleanliness", 100),
    ("W292", "\u2795 Added newline at EOF", "Files should end with newline", "POSIX standard, no effect on code behavior", "Prevents warnings from many tools", 100),
    ("E711", "\U0001f50d Fixed None comparison", "Should use `is None` not `== None`", "`is` checks identity; `== None` can be overridden", "More Pythonic, follows PEP 8", 100),
    ("F841", "\u26a0\ufe0f Unused variable assignment", "Variable assigned but never used", "Might be intentional (e.g., placeholder)", "Could indicate incomplete logic or debugging leftover", 50),
    ("E501", "\U0001f4cf Line too long", "Line exceeds character limit", "Requires manual refactoring decisions", "Affects readability on narrow screens", 30),
)
values = lambda rows: ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x) for x in r) + ")" for r in rows)
Q = "chr(34)"
FIND = """SELECT id, repo_id, bug_class, severity, confidence, problem_statement, path, line_range, n_strategies, n_files FROM (SELECT run_id * 10 + CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS id, repository_id AS repo_id,
  CASE WHEN run_id % 3 <> 0 THEN 'style_' || CAST(run_id % 5 AS VARCHAR) ELSE ['crash_risks', 'resource_leaks', 'reliability_anti_patterns', 'scalability_risks', 'edge_case_vulnerabilities'][1 + run_id % 5] END AS bug_class, upper(severity) AS severity, CAST(run_id * 7 % 101 AS INT) AS confidence,
  repeat('Problem ' || CAST(run_id % 20 AS VARCHAR) || ' ', CAST(1 + run_id % 37 AS INT)) AS problem_statement, CAST(1 + run_id % 5 AS INT) AS n_strategies, list(DISTINCT file_path ORDER BY file_path) AS paths, count(DISTINCT file_path) AS n_files,
  min(file_path) AS path, CAST(min(line_number) AS VARCHAR) || '-' || CAST(max(line_number) AS VARCHAR) AS line_range FROM analysis_results r JOIN analysis_runs a ON a.id = r.run_id GROUP BY run_id, repository_id, severity)"""
FINDP = FIND.replace("n_files FROM (", "n_files, paths FROM (")


def find(v: Views):
    """Findings derived from issues: one for each run and severity, with its distinct files."""
    r = v.analysis_results.join(v.analysis_runs.select(F.col("id").alias("run_id"), "repository_id"), "run_id")
    g = r.groupBy("run_id", "repository_id", "severity").agg(F.array_sort(F.collect_set("file_path")).alias("paths"), F.min("line_number").alias("a"), F.max("line_number").alias("b"))
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    text = lambda m: (F.col("run_id") % m).cast("string")
    span = F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))
    return g.select(
        (F.col("run_id") * 10 + rank).alias("id"), F.col("repository_id").alias("repo_id"), F.when(F.col("run_id") % 3 != 0, F.concat(F.lit("style_"), text(5))).otherwise(F.element_at(F.array(*map(F.lit, fd.RELIABILITY)), (1 + F.col("run_id") % 5).cast("int"))).alias("bug_class"), F.upper("severity").alias("severity"),
        (F.col("run_id") * 7 % 101).cast("int").alias("confidence"), F.repeat(F.concat(F.lit("Problem "), text(20), F.lit(" ")), (1 + F.col("run_id") % 37).cast("int")).alias("problem_statement"),
        F.transform("paths", lambda p: F.struct(p.alias("path"), span.alias("line_range"), F.lit("MEDIUM").alias("severity"))).alias("affected_files"), (1 + F.col("run_id") % 5).cast("int").alias("n_strategies"),
    )


def table(v: Views, rows, schema: str):
    return v.spark.createDataFrame(list(rows), schema)


def rules(v: Views):
    return table(v, RULES, "issue_code string, safety string, score int, title string")


def bridge(v: Views):
    return table(v, BRIDGE, "plan string, analyzer_id string")


def uuid_sql(x: str) -> str:
    return f"substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-' || substr({x}, 13, 4) || '-' || substr({x}, 17, 4) || '-' || substr({x}, 21, 12)"


add("fd_proposal_id", lambda v: find(v).select("id", fd.proposal_id().alias("proposal_id")), f"""
WITH t AS (SELECT id, sha256('{{"affected_files": [' || array_to_string(list_transform(paths, lambda x: {Q} || x || {Q}), ', ') || '], "bug_class": "' || bug_class || '", "problem_statement": "' || problem_statement || '", "severity": "' || severity || '"}}') AS h FROM ({FINDP}))
SELECT id, {uuid_sql('h')} AS proposal_id FROM t""")
add("fd_strategy_id", lambda v: v.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("do \"it\"").alias("description"), F.lit("low").alias("effort_estimate")).select("id", fd.strategy_id().alias("strategy_id")), f"""
WITH t AS (SELECT p_partkey AS id, sha256('{{"description": "do \\"it\\"", "effort_estimate": "low", "name": "' || p_name || '"}}') AS h FROM part) SELECT id, {uuid_sql('h')} AS strategy_id FROM t""")
add("fd_entry_id", lambda v: v.events.select("event_id", F.col("event_type").alias("analyzer"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("proposal_id"), (F.col("event_id") * 1000).alias("timestamp_ms")).select("event_id", fd.entry_id().alias("entry_id")), """
SELECT event_id, substr(sha256('{"analyzer": "' || event_type || '", "proposal_id": "p' || CAST(user_id AS VARCHAR) || '", "timestamp_ms": ' || CAST(event_id * 1000 AS VARCHAR) || '}'), 1, 16) AS entry_id FROM events""")


def full(v: Views):
    """Findings with all texts, of which some lack files, strategies or their parts, reasons or decisions, by their id."""
    strategy = lambda i: F.struct(F.concat(F.lit("way "), i.cast("string")).alias("name"), F.when(i % 3 != 0, F.concat(F.lit("Do step "), i.cast("string"))).otherwise("").alias("description"), F.when(i % 4 != 0, F.array(F.lit("read"))).otherwise(F.array().cast("array<string>")).alias("prerequisite_actions"), F.array(F.lit("none")).alias("assumptions"))
    t = find(v).withColumn("suggested_strategies", F.transform(F.sequence(F.lit(1), F.col("n_strategies")), strategy))
    t = t.withColumn("suggested_strategies", F.when(F.col("id") % 17 == 0, F.slice("suggested_strategies", 1, 0)).otherwise(F.col("suggested_strategies"))).withColumn("n_strategies", F.size("suggested_strategies"))
    files = F.when(F.col("id") % 13 == 0, F.slice("affected_files", 1, 0)).otherwise(F.col("affected_files"))
    return t.withColumns({
        "affected_files": files, "risk_explanation": F.when(F.col("id") % 7 != 0, F.concat(F.lit("It may fail: "), F.col("problem_statement"))), "root_cause_hypothesis": F.when(F.col("id") % 19 != 0, "haste").otherwise(""),
        "confidence_explanation": F.when(F.col("id") % 2 == 0, "because"), "requires_human_decision": F.col("id") % 5 == 0, "decision_required_for": F.when(F.col("id") % 10 == 0, "the design"),
    })


FULL = f"""SELECT *, {{}} FROM (SELECT * REPLACE (CASE WHEN id % 17 = 0 THEN 0 ELSE n_strategies END AS n_strategies, CASE WHEN id % 13 = 0 THEN 0 ELSE n_files END AS n_files), CASE WHEN id % 7 <> 0 THEN 'It may fail: ' || problem_statement END AS risk_explanation FROM ({FIND}))"""
add("fd_validate", lambda v: full(v).select("id", F.array_join(fd.validation_errors(), "; ").alias("errors")), f"""
SELECT id, array_to_string(list_filter([CASE WHEN id % 19 = 0 THEN 'root_cause_hypothesis is required' END, CASE WHEN risk_explanation IS NULL THEN 'risk_explanation is required' END, CASE WHEN n_strategies < 2 THEN 'Must have >= 2 suggested strategies' END]
  || flatten(list_transform(range(n_strategies), lambda i: [CASE WHEN (i + 1) % 3 = 0 THEN 'Strategy ' || i || ' missing description' END, CASE WHEN (i + 1) % 4 = 0 THEN 'Strategy ' || i || ' missing prerequisite_actions' END]))
  || [CASE WHEN confidence < 60 AND id % 2 <> 0 THEN 'Low confidence (<60%) requires explanation' END, CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN 'If requires_human_decision, must specify decision_required_for' END,
  CASE WHEN length(problem_statement) > 500 THEN 'problem_statement too long (' || length(problem_statement) || ' > 500)' END, CASE WHEN length(risk_explanation) > 1000 THEN 'risk_explanation too long (' || length(risk_explanation) || ' > 1000)' END], lambda x: x IS NOT NULL), '; ') AS errors FROM ({FULL.format('0 AS z')})""")
HITS = "SELECT repo_id, CASE WHEN contains(text, 'open(') THEN 'open' ELSE 'sleep' END AS rule_id, path, line_no FROM source_lines WHERE contains(text, 'open(') OR contains(text, 'sleep(')"


def _hits(v: Views):
    t = F.col("text")
    return v.source_lines.where(t.contains("open(") | t.contains("sleep(")).select("repo_id", F.when(t.contains("open("), "open").otherwise("sleep").alias("rule_id"), "path", "line_no")


add("fd_group", lambda v: fd.group_hits(_hits(v)).select("repo_id", "rule_id", "hits", F.array_join(F.transform("affected_files", lambda f: F.concat_ws(" ", f["path"], f["line_range"], f["severity"])), ",").alias("files"), "problem_statement"), f"""
WITH p AS (SELECT repo_id, rule_id, path, min(line_no) AS a, max(line_no) AS b, count(*) AS n FROM ({HITS}) GROUP BY 1, 2, 3)
SELECT repo_id, rule_id, CAST(sum(n) AS BIGINT) AS hits, string_agg(path || ' ' || CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) || ' ' || CASE WHEN n > 3 THEN 'HIGH' ELSE 'MEDIUM' END, ',' ORDER BY path) AS files, CAST(sum(n) AS VARCHAR) || ' hits of ' || rule_id AS problem_statement FROM p GROUP BY 1, 2""")
add("fd_file_severity", lambda v: _hits(v).groupBy("repo_id", "rule_id", "path").agg(F.count("*").alias("n")).withColumn("severity", fd.file_severity()), f"SELECT repo_id, rule_id, path, count(*) AS n, CASE WHEN count(*) > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM ({HITS}) GROUP BY 1, 2, 3")
add("fd_file_cap", lambda v: fd.capped_files(find(v), 2), f"""
SELECT id, i - 1 AS place, CASE WHEN i <= 2 THEN paths[i] ELSE '... and ' || CAST(n_files - 2 AS VARCHAR) || ' more files' END AS path FROM (SELECT id, paths, n_files, unnest(range(1, least(n_files, 3) + 1)) AS i FROM ({FINDP}))""")
KEYED = f"SELECT id, CAST(repo_id AS VARCHAR) || '|' || array_to_string(paths[1:3], ',') || '|' || substr(problem_statement, 1, 50) AS k FROM ({FINDP})"
CONFLICTS = f"WITH k AS ({KEYED}), g AS (SELECT k, count(*) AS n, list(id ORDER BY id) AS ids FROM k GROUP BY 1 HAVING count(*) > 1) SELECT id, n - 1 AS n_others, CASE WHEN id = ids[1] THEN ids[2] ELSE ids[1] END AS first_other FROM k JOIN g ON g.k = k.k"
add("fd_conflicts", lambda v: fd.conflicts(find(v)), CONFLICTS)
add("fd_conflict_ids", lambda v: fd.conflict_groups(find(v)).select("id", F.array_join("conflicts", ",").alias("conflicts")), f"""
WITH k AS ({KEYED}) SELECT a.id, string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id) AS conflicts FROM k a JOIN k b ON a.k = b.k AND a.id <> b.id GROUP BY 1""")
add("fd_counts", lambda v: fd.counts(find(v)), f"SELECT 'severity' AS kind, severity AS value, count(*) AS findings FROM ({FIND}) GROUP BY 2 UNION ALL SELECT 'bug_class', bug_class, count(*) FROM ({FIND}) GROUP BY 2")
SEV = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in fd.SEVERITIES)
add("fd_run_summary", lambda v: fd.run_summary(find(v), 3), f"SELECT count(*) AS findings, count(DISTINCT repo_id) AS repositories, {SEV}, (SELECT count(*) FROM ({CONFLICTS})) AS conflicts, 3 AS skipped FROM ({FIND})")
add("fd_overview", lambda v: fd.overview(find(v)), f"SELECT count(*) AS total, {SEV}, round(avg(confidence), 1) AS average_confidence, count(*) FILTER (WHERE confidence < 60) AS low_confidence FROM ({FIND})")
add("fd_sort", lambda v: fd.sort_findings(find(v)), f"SELECT id, path AS first_path, CAST(split_part(line_range, '-', 1) AS INT) AS first_line, bug_class FROM ({FIND})")
REL = "bug_class IN ('crash_risks', 'resource_leaks', 'reliability_anti_patterns', 'scalability_risks', 'edge_case_vulnerabilities')"
RISK = f"""WITH a AS (SELECT *, CASE WHEN {REL} THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN n_files = 1 THEN 0 WHEN n_files <= 3 THEN 0.3 ELSE 0.6 END::DOUBLE + CASE severity WHEN 'CRITICAL' THEN 0.4 WHEN 'HIGH' THEN 0.2 WHEN 'MEDIUM' THEN 0.1 ELSE 0 END::DOUBLE AS p FROM ({FULL.format('0 AS z')})),
b AS (SELECT *, CASE WHEN {REL} AND severity = 'CRITICAL' THEN greatest(p, 0.7::DOUBLE) ELSE p END + CASE WHEN length(problem_statement) < 100 THEN 0 WHEN length(problem_statement) < 300 THEN 0.2 ELSE 0.4 END::DOUBLE + CASE WHEN n_strategies > 3 THEN 0.2 ELSE 0 END::DOUBLE AS points FROM a),
c AS (SELECT *, CASE WHEN points < 0.3::DOUBLE THEN 'LOW' WHEN points < 0.7::DOUBLE THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM b),
d AS (SELECT *, CASE WHEN {REL} AND severity IN ('CRITICAL', 'HIGH') THEN CASE risk_level WHEN 'LOW' THEN 0.95 WHEN 'MEDIUM' THEN 0.85 ELSE 0.75 END ELSE CASE risk_level WHEN 'LOW' THEN 0.8 WHEN 'MEDIUM' THEN 0.7 ELSE 0.6 END END::DOUBLE AS risk_confidence FROM c)"""
RISKS = f"{RISK} SELECT id, points, risk_level, risk_confidence FROM d"
add("fd_risk", lambda v: fd.risks(full(v)), RISKS)
add("fd_risk_factors", lambda v: fd.risk_factors(full(v)).select("id", F.array_join("factors", "; ").alias("factors")), f"""
SELECT id, array_to_string(list_filter([CASE WHEN {REL} THEN 'reliability bug (production-critical)' END, CASE WHEN n_files = 1 THEN 'single file' WHEN n_files <= 3 THEN n_files || ' files' ELSE n_files || ' files (multi-file)' END,
  CASE severity WHEN 'CRITICAL' THEN 'critical severity' WHEN 'HIGH' THEN 'high severity' WHEN 'MEDIUM' THEN 'medium severity' ELSE 'low severity' END, CASE WHEN length(problem_statement) < 100 THEN 'small change' WHEN length(problem_statement) < 300 THEN 'medium change' ELSE 'large change' END,
  CASE WHEN n_strategies > 3 THEN n_strategies || ' strategies (complex)' END, CASE WHEN {REL} AND severity IN ('CRITICAL', 'HIGH') THEN 'high confidence (known reliability pattern)' END], lambda x: x IS NOT NULL), '; ') AS factors FROM ({FULL.format('0 AS z')})""")
STEP = "CASE WHEN {0} % 3 <> 0 THEN 'Do step ' || {0} ELSE '' END"
CAND = f"""{RISK} SELECT id, path AS file_path, 0 AS line, coalesce(risk_explanation, '') AS original_code, CASE WHEN n_strategies > 0 THEN '# Proposed fix: Do step 1' ELSE '# Fix to be determined' END AS fixed_code, 'proposed' AS status, risk_level, CAST(floor(risk_confidence * 100) AS INT) AS confidence, bug_class,
  CAST(split_part(line_range, '-', 1) AS INT) AS first_line, 'Problem: ' || problem_statement || CASE WHEN n_strategies > 0 THEN chr(10) || chr(10) || 'Proposed Strategies:' || chr(10) || array_to_string(list_transform(range(1, least(n_strategies, 3) + 1), lambda i: i || '. way ' || i || ': ' || {STEP.format('i')}), chr(10)) ELSE '' END AS explanation,
  '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -' || line_range || ',1 +' || line_range || ',1 @@' || chr(10) || '-' || coalesce(substr(risk_explanation, 1, 100), '# existing code') || chr(10) || '+# Fixed: ' || CASE WHEN n_strategies > 0 THEN 'Do step 1' ELSE '' END || chr(10) AS patch FROM d WHERE n_files > 0"""
add("fd_candidate", lambda v: fd.candidates(full(v)), CAND)
add("fd_dedup", lambda v: fd.dedup_candidates(fd.candidates(full(v)).union(fd.candidates(full(v)))), f"SELECT id, file_path, sha256(file_path || ':0:' || CAST(id AS VARCHAR)) AS key FROM ({CAND})")
add("fd_risk_dist", lambda v: fd.risk_distribution(fd.risks(full(v))), f"SELECT count(*) FILTER (WHERE risk_level = 'LOW') AS low, count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium, count(*) FILTER (WHERE risk_level = 'HIGH') AS high FROM ({RISKS})")
EVID = "SELECT run_id AS id, id AS place, CASE WHEN run_id % 23 <> 0 THEN CASE severity WHEN 'critical' THEN 'static_pattern' WHEN 'high' THEN 'heuristic' WHEN 'medium' THEN 'naming_convention' ELSE 'runtime_assumption' END END AS source, issue_code || ' in ' || file_path AS detail FROM analysis_results"
AGAINST = "SELECT run_id AS id, id AS place, 'seen ' || line_number AS detail FROM analysis_results WHERE id % 5 = 0"
CALIB = f"SELECT e.id, CAST(CASE WHEN count(source) = 0 THEN 50 ELSE greatest(0, least(100, floor(sum(CASE source WHEN 'static_pattern' THEN 95 WHEN 'heuristic' THEN 70 WHEN 'naming_convention' THEN 50 WHEN 'runtime_assumption' THEN 40 END) / count(source)) - 10 * coalesce(max(c), 0))) END AS INT) AS calibrated FROM ({EVID}) e LEFT JOIN (SELECT id, count(*) AS c FROM ({AGAINST}) GROUP BY 1) a ON a.id = e.id GROUP BY 1"


def _evidence(v: Views):
    s = F.col("severity")
    kind = F.when(s == "critical", "static_pattern").when(s == "high", "heuristic").when(s == "medium", "naming_convention").otherwise("runtime_assumption")
    return v.analysis_results.select(F.col("run_id").alias("id"), F.col("id").alias("at"), F.when(F.col("run_id") % 23 != 0, kind).alias("source"), F.concat("issue_code", F.lit(" in "), "file_path").alias("detail"))


def _against(v: Views):
    return v.analysis_results.where("id % 5 = 0").select(F.col("run_id").alias("id"), F.col("id").alias("at"), F.concat(F.lit("seen "), F.col("line_number").cast("string")).alias("detail"))


add("fd_confidence", lambda v: fd.evidence_confidence(_evidence(v), _against(v)), CALIB)
add("fd_assessment", lambda v: fd.assessments(_evidence(v), _against(v)), f"""
SELECT c.id, calibrated, CASE WHEN e.t IS NULL THEN 'No evidence collected. Confidence score is neutral.' ELSE 'Supporting evidence:' || chr(10) || e.t || coalesce(chr(10) || chr(10) || 'Conflicting evidence:' || chr(10) || a.t, '') || chr(10) || chr(10) || 'Overall: ' ||
  CASE WHEN calibrated >= 80 THEN 'High confidence: Evidence is strong and reliable.' WHEN calibrated >= 60 THEN 'Moderate confidence: Evidence is reasonable but has some limitations.' WHEN calibrated >= 40 THEN 'Lower confidence: Evidence is based on heuristics; manual review recommended.' ELSE 'Low confidence: Evidence is limited; treat as exploratory.' END END AS explanation
FROM ({CALIB}) c LEFT JOIN (SELECT id, string_agg('  - ' || source || ': ' || detail, chr(10) ORDER BY place) AS t FROM ({EVID}) WHERE source IS NOT NULL GROUP BY 1) e ON e.id = c.id LEFT JOIN (SELECT id, string_agg('  - ' || detail, chr(10) ORDER BY place) AS t FROM ({AGAINST}) GROUP BY 1) a ON a.id = c.id""")
add("fd_adjust_severity", lambda v: find(v).withColumn("severity", F.when(F.col("id") % 9 == 0, "INFO").otherwise(F.col("severity"))).select("id", fd.adjusted_severity(F.col("severity"), F.col("confidence")).alias("adjusted")), f"""
SELECT id, CASE WHEN confidence < 40 THEN CASE s WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END WHEN confidence < 60 AND s = 'CRITICAL' THEN 'HIGH' ELSE s END AS adjusted FROM (SELECT *, CASE WHEN id % 9 = 0 THEN 'INFO' ELSE severity END AS s FROM ({FIND}))""")
add("fd_risk_score", lambda v: find(v).select("id", fd.risk_score(F.col("severity"), F.col("confidence")).alias("risk_score")), f"SELECT id, CAST(least(100, floor(CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 ELSE 25 END * confidence / 100)) AS INT) AS risk_score FROM ({FIND})")
CLASS = f"""WITH d(issue_code, safety, score, title) AS (VALUES {values(RULES)}), best AS (SELECT issue_code, min_by(safety, CASE safety WHEN 'SAFE' THEN 0 ELSE 1 END) AS safety, min_by(score, CASE safety WHEN 'SAFE' THEN 0 ELSE 1 END) AS score, min_by(title, CASE safety WHEN 'SAFE' THEN 0 ELSE 1 END) AS title FROM d GROUP BY 1),
cl AS (SELECT r.id, r.issue_code, r.category, r.is_fixed, coalesce(b.safety, 'SUGGEST') AS safety, coalesce(b.score, 0) AS rule_score, coalesce(b.title, 'Rule ' || r.issue_code) AS title FROM analysis_results r LEFT JOIN best b ON b.issue_code = r.issue_code)"""
_class = lambda v: fd.classify(v.analysis_results.select("id", "issue_code"), rules(v))
add("fd_classify", _class, f"{CLASS} SELECT id, issue_code, safety, rule_score, title FROM cl")
add("fd_group_category", lambda v: fd.category_summary(_class(v)), f"{CLASS} SELECT count(*) AS total, count(*) FILTER (WHERE safety = 'SAFE') AS safe, count(*) FILTER (WHERE safety = 'RISKY') AS risky, count(*) FILTER (WHERE safety = 'SUGGEST') AS suggest, count(*) FILTER (WHERE safety = 'SAFE') AS auto_fixable FROM cl")
add("fd_fix_plan", lambda v: fd.fix_plan(_class(v), "smart"), f"{CLASS} SELECT issue_code, CASE safety WHEN 'SAFE' THEN 'fix' WHEN 'RISKY' THEN 'review' ELSE 'suggest' END AS action, count(*) AS issues FROM cl GROUP BY 1, 2")
add("fd_recategorize", lambda v: fd.recategorize(v.analysis_results, rules(v)), f"""{CLASS}, n AS (SELECT *, CASE safety WHEN 'SAFE' THEN 'safe' WHEN 'RISKY' THEN 'review' ELSE 'suggestion' END AS c, CASE WHEN safety = 'SAFE' THEN 1 ELSE is_fixed END AS f FROM cl)
SELECT id, c AS category, f AS is_fixed FROM n WHERE c IS DISTINCT FROM category OR f IS DISTINCT FROM is_fixed""")


def _recategorized(v: Views):
    """The issues as a stored table, their categories and states merged in: what is stored then."""
    table = stores.KeyedTable(v.spark, scratch_dir(v.spark), "id long, issue_code string, category string, is_fixed int", ("id",), buckets=16)
    table.merge(0, v.analysis_results.select("id", "issue_code", "category", "is_fixed"))
    table.merge(1, fd.recategorize(table.read(), rules(v)), only_matched=True)
    return table.read()


add("fd_recategorize_store", _recategorized, f"""{CLASS} SELECT id, issue_code, CASE safety WHEN 'SAFE' THEN 'safe' WHEN 'RISKY' THEN 'review' ELSE 'suggestion' END AS category, CASE WHEN safety = 'SAFE' THEN 1 ELSE is_fixed END AS is_fixed FROM cl""")
add("fd_categorize_js", lambda v: fd.categorize_js(v.analysis_results.select("id", "issue_code"), ("F401", "W291"), ("E711",)), "SELECT id, issue_code, CASE WHEN issue_code IN ('F401', 'W291') THEN 'safe' WHEN issue_code = 'E711' THEN 'review' ELSE 'suggestion' END AS category FROM analysis_results")
add("fd_explain", lambda v: fd.explain(v.analysis_results.select("id", "issue_code"), table(v, EXPLAINED, "issue_code string, title string, description string, why_safe string, impact string, safety_score int")), f"""
WITH t(issue_code, title, description, why_safe, impact, safety_score) AS (VALUES {values(EXPLAINED)}) SELECT r.id, r.issue_code, coalesce(title, 'Rule ' || r.issue_code) AS title, coalesce(description, 'Code quality issue') AS description, coalesce(why_safe, 'Unknown') AS why_safe,
  coalesce(impact, 'See Ruff docs') AS impact, coalesce(safety_score, 0) AS safety_score FROM analysis_results r LEFT JOIN t ON t.issue_code = r.issue_code""")
#: Batches: fixes by the hundred of their issue, some ids twice and some unknown (but for every eighth batch).
BATCH = "SELECT id // 40000 AS batch_id, id AS fix_id FROM code_fixes UNION ALL SELECT id // 40000, id FROM code_fixes WHERE id % 30 = 0 AND id // 40000 % 8 <> 0 UNION ALL SELECT id // 40000, -id FROM code_fixes WHERE id % 50 = 0 AND id // 40000 % 8 <> 0"
FIXED = "SELECT batch_id, fix_id, count(*) AS times FROM (" + BATCH + ") GROUP BY 1, 2"
CLASH = f"SELECT batch_id, file_path, count(*) AS fixes FROM ({FIXED}) b JOIN code_fixes f ON f.id = b.fix_id GROUP BY 1, 2 HAVING count(*) > 1"
#: Fixes with codes, patches and all states: half of the pending ones are generated, some lack a patch, some a code too; in every eighth batch all are approved.
FIXES = "SELECT id, file_path, CASE WHEN id // 40000 % 8 = 0 THEN 'approved' WHEN status = 'pending' AND id % 4 = 0 THEN 'generated' ELSE status END AS status, risk_level, CASE WHEN id % 6 <> 0 THEN '+ ' || status END AS patch, 'a' || chr(10) || 'b' || chr(10) AS original_code, CASE WHEN id % 12 <> 0 THEN 'a' || chr(10) || 'c' || chr(10) END AS fixed_code FROM code_fixes"
VALID = f"""WITH j AS (SELECT b.*, file_path, status, risk_level FROM ({FIXED}) b LEFT JOIN ({FIXES}) f ON f.id = b.fix_id), o AS (SELECT batch_id, count(status) AS size, count(DISTINCT file_path) AS files, count(*) FILTER (WHERE times > 1) AS duplicates, count(*) FILTER (WHERE status IS NULL) AS missing,
  count(*) FILTER (WHERE status IS NOT NULL AND status <> 'approved') AS wrong_state, max(CASE risk_level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS h, {', '.join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in fd.STATUSES)} FROM j GROUP BY 1), k AS (SELECT o.*, coalesce(c.n, 0) AS warnings FROM o LEFT JOIN (SELECT batch_id, count(*) AS n FROM ({CLASH}) GROUP BY 1) c ON c.batch_id = o.batch_id)
SELECT batch_id, size, files, duplicates, missing, wrong_state, warnings, CASE h WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, {', '.join(fd.STATUSES)}, size > 0 AND duplicates = 0 AND missing = 0 AND wrong_state = 0 AS valid FROM k"""


def _batches(v: Views):
    f = v.code_fixes.select(F.floor(F.col("id") / 40000).alias("batch_id"), F.col("id").alias("fix_id"))
    odd = f.where("batch_id % 8 <> 0")
    return f.union(odd.where("fix_id % 30 = 0")).union(odd.where("fix_id % 50 = 0").select("batch_id", -F.col("fix_id")))


def _fixes(v: Views):
    status = F.when(F.floor(F.col("id") / 40000) % 8 == 0, "approved").when((F.col("status") == "pending") & (F.col("id") % 4 == 0), "generated").otherwise(F.col("status"))
    patch = F.when(F.col("id") % 6 != 0, F.concat(F.lit("+ "), "status"))
    return v.code_fixes.select("id", "file_path", status.alias("status"), "risk_level", patch.alias("patch"), F.lit("a\nb\n").alias("original_code"), F.when(F.col("id") % 12 != 0, "a\nc\n").alias("fixed_code"))


add("fd_batch_validate", lambda v: fd.batch_validation(_batches(v), _fixes(v), "apply"), VALID)
add("fd_batch_conflicts", lambda v: fd.batch_conflicts(_batches(v), v.code_fixes), CLASH)
REQ = "SELECT b.fix_id * 10 + CASE CAST(b.fix_id % 3 AS INT) WHEN 0 THEN 0 ELSE 1 END AS request_id, b.fix_id, CASE CAST(abs(b.fix_id) // 2 % 3 AS INT) WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'apply' END AS operation, b.fix_id % 11 <> 0 AS can FROM (SELECT DISTINCT fix_id FROM (" + BATCH + ")) b"
OUT = f"""SELECT request_id, fix_id, CASE WHEN error IS NULL THEN CASE operation WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'applied' END ELSE status END AS status, CASE WHEN error IS NULL THEN 'reviewer' END AS actor, CASE WHEN error IS NULL THEN TIMESTAMP '{AS_OF}' END AS at, error FROM
(SELECT q.*, f.status, CASE WHEN NOT can THEN 'plan_restriction' WHEN f.status IS NULL THEN 'not_found' WHEN operation = 'apply' AND f.status <> 'approved' THEN 'validation_failed' WHEN operation <> 'apply' AND f.status NOT IN ('proposed', 'generated') THEN 'invalid_state' END AS error
FROM ({REQ}) q LEFT JOIN ({FIXES}) f ON f.id = q.fix_id)"""


def _outcomes(v: Views):
    b = _batches(v).select("fix_id").distinct()
    m = F.floor(F.abs(F.col("fix_id")) / 2) % 3
    req = b.select(
        (F.col("fix_id") * 10 + F.when(F.col("fix_id") % 3 == 0, 0).otherwise(1)).alias("request_id"), "fix_id", F.when(m == 0, "approve").when(m == 1, "reject").otherwise("apply").alias("operation"),
        F.lit("reviewer").alias("actor"), F.lit(AS_OF).cast("timestamp").alias("at"), (F.col("fix_id") % 11 != 0).alias("can"),
    )
    return fd.transitions(req, _fixes(v))


add("fd_transition", _outcomes, OUT)


def _moved(v: Views):
    """The fixes as a stored table, what was approved, rejected and applied merged in with who did it and when: what is stored then."""
    table = stores.KeyedTable(v.spark, scratch_dir(v.spark), "id long, file_path string, status string, actor string, at timestamp", ("id",), buckets=16)
    table.merge(0, _fixes(v).select("id", "file_path", "status"))
    done = _outcomes(v).where("error IS NULL")
    table.merge(1, done.select(F.col("fix_id").alias("id"), "status", "actor", "at"), only_matched=True)
    return table.read()


add("fd_transition_store", _moved, f"SELECT f.id, f.file_path, coalesce(o.status, f.status) AS status, o.actor, o.at FROM ({FIXES}) f LEFT JOIN (SELECT * FROM ({OUT}) WHERE error IS NULL) o ON o.fix_id = f.id")
add("fd_batch_outcome", lambda v: fd.batch_outcomes(_outcomes(v), _batches(v)), f"SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS succeeded, count(*) FILTER (WHERE error IS NOT NULL) AS failed FROM (SELECT DISTINCT batch_id, fix_id FROM ({BATCH})) b JOIN ({OUT}) o ON o.fix_id = b.fix_id GROUP BY 1")
PATCH = f"""SELECT batch_id, string_agg('# Fix #' || fix_id || ': ' || file_path || chr(10) || coalesce(patch, '--- a/' || file_path || '+++ b/' || file_path || '@@ -1,2 +1,2 @@ a' || chr(10) || '-b' || chr(10) || '+c' || chr(10)) || chr(10), chr(10) ORDER BY file_path, fix_id) AS patch
FROM ({FIXED}) b JOIN ({FIXES}) f ON f.id = b.fix_id WHERE patch IS NOT NULL OR fixed_code IS NOT NULL GROUP BY 1"""
add("fd_combined_patch", lambda v: fd.combined_patches(_batches(v), _fixes(v)), PATCH)
add("fd_batch_preview", lambda v: fd.batch_preview(fd.combined_patches(_batches(v), _fixes(v)), fd.batch_validation(_batches(v), _fixes(v), "apply")), f"SELECT x.batch_id, CASE WHEN valid THEN sha256(coalesce(patch, '')) END AS sha256, CASE WHEN valid THEN length(coalesce(patch, '')) ELSE 0 END AS size FROM ({VALID}) x LEFT JOIN ({PATCH}) p ON x.batch_id = p.batch_id")


def _checked(v: Views):
    """Fixes of the given files, by their number, each with the file's text as it was: some with other white space at the ends, some changed."""
    files = v.source_files
    at = F.regexp_extract("path", r"m(\d+)\.", 1).cast("long")
    old = F.when(at % 4 < 2, F.col("content")).when(at % 4 == 2, F.concat(F.lit("\n "), "content", F.lit("\n\n"))).otherwise(F.concat("content", F.lit("x")))
    status = F.when(at % 5 != 4, "approved").otherwise("proposed")
    fixes = files.select(at.alias("id"), F.when(at % 7 == 6, F.col("repo_id") + 100000).otherwise(F.col("repo_id")).alias("repo_id"), status.alias("status"), F.when(at % 11 != 10, F.col("path")).alias("file_path"), old.alias("original_code"), F.when(at % 3 != 2, F.lit("")).otherwise(old).alias("fixed_code"))
    found = fd.validate_fixes(fixes, files)
    return found.select("id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


add("fd_validate_fix", _checked, r"""
WITH f AS (SELECT CAST(regexp_extract(path, 'm(\d+)\.', 1) AS BIGINT) AS id FROM source_files),
e AS (SELECT id, CASE WHEN id % 5 = 4 THEN 'not approved: proposed' END AS e1, CASE WHEN id % 11 = 10 THEN 'no path' WHEN id % 7 = 6 THEN 'file not found' WHEN id % 4 = 3 THEN 'content changed' END AS e2 FROM f)
SELECT id, array_to_string(list_filter([e1, e2], lambda x: x IS NOT NULL), '; ') AS errors,
  array_to_string(list_filter([CASE WHEN id % 4 = 2 AND id % 11 <> 10 AND id % 7 <> 6 THEN 'white space differs' END, CASE WHEN e1 IS NULL AND e2 IS NULL AND id % 3 = 2 THEN 'patch is empty' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM e""")
WANTED = "SELECT DISTINCT CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'developer' WHEN 1 THEN 'team' ELSE 'enterprise' END AS plan, CASE CAST(o_orderkey % 19 AS INT) " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(ANALYZERS[:-1])) + f" ELSE '{ANALYZERS[-1][0]}' END AS analyzer_id FROM orders"


def _pick(col: str, names):
    out = F.lit(names[-1])
    for i, n in enumerate(names[:-1]):
        out = F.when(F.col(col) % len(names) == i, n).otherwise(out)
    return out


def _wanted(v: Views):
    return v.orders.select(_pick("o_custkey", fd.PLANS).alias("plan"), _pick("o_orderkey", [a for a, _ in ANALYZERS]).alias("analyzer_id")).distinct()


add("fd_allowed", lambda v: fd.allowed_analyzers(_wanted(v), bridge(v)), f"WITH b(plan, analyzer_id) AS (VALUES {values(BRIDGE)}) SELECT w.plan, w.analyzer_id, b.plan IS NOT NULL AS allowed, CASE WHEN b.plan IS NULL THEN 'not in plan ' || w.plan END AS reason FROM ({WANTED}) w LEFT JOIN b ON b.plan = w.plan AND b.analyzer_id = w.analyzer_id")
add("fd_plan_cutoff", lambda v: fd.plan_cutoff(_wanted(v).select("analyzer_id").distinct().join(table(v, ANALYZERS, "analyzer_id string, min_plan string"), "analyzer_id"), "team"), f"WITH a(analyzer_id, min_plan) AS (VALUES {values(ANALYZERS)}) SELECT analyzer_id, min_plan FROM a WHERE min_plan IN ('developer', 'team') AND analyzer_id IN (SELECT analyzer_id FROM ({WANTED}))")
SEL = "SELECT o_custkey, CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'developer' WHEN 1 THEN 'team' WHEN 2 THEN 'enterprise' ELSE 'gold' END AS plan, CASE WHEN o_orderkey % 7 = 6 THEN 'mystery' ELSE a END AS analyzer_id FROM (SELECT *, CASE CAST(o_orderkey % 19 AS INT) " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(ANALYZERS[:-1])) + f" ELSE '{ANALYZERS[-1][0]}' END AS a FROM orders)"
add("fd_selection_check", lambda v: fd.selection_errors(v.orders.select("o_custkey", _pick("o_custkey", (*fd.PLANS, "gold")).alias("plan"), F.when(F.col("o_orderkey") % 7 == 6, "mystery").otherwise(_pick("o_orderkey", [a for a, _ in ANALYZERS])).alias("analyzer_id")), table(v, ANALYZERS, "analyzer_id string, min_plan string"), "o_custkey"), f"""
WITH a(analyzer_id, min_plan) AS (VALUES {values(ANALYZERS)}), s AS (SELECT o_custkey, plan, analyzer_id, count(*) AS n FROM ({SEL}) GROUP BY 1, 2, 3), r(p, k) AS (VALUES ('developer', 0), ('team', 1), ('enterprise', 2)),
j AS (SELECT s.*, min_plan, r.k AS rank, q.k AS need FROM s LEFT JOIN a ON a.analyzer_id = s.analyzer_id LEFT JOIN r ON r.p = s.plan LEFT JOIN r q ON q.p = min_plan)
SELECT o_custkey, plan, analyzer_id, 'unknown plan' AS error FROM j WHERE rank IS NULL UNION ALL SELECT o_custkey, plan, analyzer_id, 'duplicate' FROM j WHERE n > 1 UNION ALL SELECT o_custkey, plan, analyzer_id, 'unknown analyzer' FROM j WHERE min_plan IS NULL UNION ALL SELECT o_custkey, plan, analyzer_id, 'plan too low' FROM j WHERE rank < need""")
add("fd_locked", lambda v: fd.locked_services(_wanted(v).select("plan", F.col("analyzer_id").alias("service")), bridge(v).withColumnRenamed("analyzer_id", "service")), f"WITH b(plan, service) AS (VALUES {values(BRIDGE)}) SELECT plan, analyzer_id AS service FROM ({WANTED}) EXCEPT SELECT plan, service FROM b")
COV = "SELECT o_custkey AS run_id, CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'developer' WHEN 1 THEN 'team' ELSE 'enterprise' END AS plan, CASE CAST(o_orderkey % 19 AS INT) " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(ANALYZERS[:-1])) + f" ELSE '{ANALYZERS[-1][0]}' END AS analyzer_id, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 AS ran FROM orders GROUP BY 1, 2, 3"


def _coverage(v: Views):
    s = v.orders.select(F.col("o_custkey").alias("run_id"), _pick("o_custkey", fd.PLANS).alias("plan"), _pick("o_orderkey", [a for a, _ in ANALYZERS]).alias("analyzer_id"), "o_orderstatus")
    return fd.coverage(s.select("run_id", "plan", "analyzer_id").distinct(), s.where("o_orderstatus = 'F'").select("run_id", "analyzer_id"), bridge(v))


add("fd_coverage", _coverage, f"WITH b(plan, analyzer_id) AS (VALUES {values(BRIDGE)}) SELECT run_id, count(*) FILTER (WHERE ran) AS executed, count(*) FILTER (WHERE NOT ran AND b.plan IS NULL) AS locked, count(*) FILTER (WHERE NOT ran AND b.plan IS NOT NULL) AS skipped FROM ({COV}) s LEFT JOIN b ON b.plan = s.plan AND b.analyzer_id = s.analyzer_id GROUP BY 1")
add("fd_quota", lambda v: fd.quotas(v.analysis_runs, v.repositories, table(v, LIMITS, "plan string, max_runs int, max_repositories int")), f"""
WITH l(plan, max_runs, max_repositories) AS (VALUES {values(LIMITS)}), p AS (SELECT installation_id, CAST(date_trunc('month', created_at) AS TIMESTAMP) AS month, count(*) AS runs, count(DISTINCT repository_id) AS repositories FROM analysis_runs a JOIN repositories r ON r.id = a.repository_id GROUP BY 1, 2),
q AS (SELECT *, CASE CAST(installation_id % 3 AS INT) WHEN 0 THEN 'developer' WHEN 1 THEN 'team' ELSE 'enterprise' END AS plan FROM p)
SELECT installation_id, month, q.plan, runs, repositories, coalesce(runs > max_runs OR repositories > max_repositories, false) AS over FROM q JOIN l ON l.plan = q.plan""")
