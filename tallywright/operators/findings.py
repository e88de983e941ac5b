"""The findings pipeline: identity, grouping, conflicts, risk, candidates, classification, plan gating, fix batches.

Findings have id, repo_id, bug_class, severity (CRITICAL, HIGH, MEDIUM, LOW), confidence (0 to 100), problem_statement,
affected_files (array of path, line_range, severity), suggested_strategies (array of name, description and more),
risk_explanation and n_strategies.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..functions.scalars import json_string, or_default, ranked, uuid_of

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
#: Weights, bands and limits. Fixed values.
SEVERITY_WEIGHT = {"CRITICAL": 100, "HIGH": 75, "MEDIUM": 50, "LOW": 25}
EVIDENCE_WEIGHT = {"static_pattern": 95, "heuristic": 70, "naming_convention": 50, "runtime_assumption": 40}
#: Least confidence, and what it means. Fixed values.
BANDS = (
    (80, "High confidence: Evidence is strong and reliable."), (60, "Moderate confidence: Evidence is reasonable but has some limitations."),
    (40, "Lower confidence: Evidence is based on heuristics; manual review recommended."), (0, "Low confidence: Evidence is limited; treat as exploratory."),
)
#: Classes of reliability findings. Fixed values.
RELIABILITY = ("crash_risks", "resource_leaks", "reliability_anti_patterns", "scalability_risks", "edge_case_vulnerabilities")
#: States of a fix, and the states that an operation takes with the one that it leads to. Fixed values.
STATUSES = ("proposed", "approved", "rejected", "applied", "failed", "pending", "generated")
TRANSITIONS = {"approve": (("proposed", "generated"), "approved"), "reject": (("proposed", "generated"), "rejected"), "apply": (("approved",), "applied")}
#: Explanation of a rule that has none: title (behind it, the code), description, reason, impact, score. Fixed values.
NO_EXPLANATION = ("Rule ", "Code quality issue", "Unknown", "See Ruff docs", 0)
PLANS = ("developer", "team", "enterprise")


def _canonical(**fields: Column) -> Column:
    """The fields as a JSON object with sorted keys, \", \" and \": \" as separators; values are JSON texts already."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), fields[name]]
    return F.concat(*parts, F.lit("}"))


def proposal_id() -> Column:
    paths = F.array_join(F.transform(F.array_sort(F.transform("affected_files", lambda f: f["path"])), json_string), ", ")
    text = _canonical(affected_files=F.concat(F.lit("["), paths, F.lit("]")), bug_class=json_string(F.col("bug_class")), problem_statement=json_string(F.col("problem_statement")), severity=json_string(F.col("severity")))
    return uuid_of(F.sha2(text, 256))


def strategy_id() -> Column:
    return uuid_of(F.sha2(_canonical(**{c: json_string(F.col(c)) for c in ("description", "effort_estimate", "name")}), 256))


def entry_id() -> Column:
    text = _canonical(analyzer=json_string(F.col("analyzer")), proposal_id=json_string(F.col("proposal_id")), timestamp_ms=F.col("timestamp_ms").cast("string"))
    return F.substring(F.sha2(text, 256), 1, 16)


def _absent(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def validation_errors() -> Column:
    """The errors of a finding (problem_statement, root_cause_hypothesis, risk_explanation, suggested_strategies: array of name, description,
    prerequisite_actions, assumptions; confidence, confidence_explanation, requires_human_decision, decision_required_for), in
    order. Each strategy's gaps are errors of their own, by its place from 0."""
    strategies = F.coalesce("suggested_strategies", F.from_json(F.lit("[]"), "array<struct<name: string, description: string, prerequisite_actions: array<string>, assumptions: array<string>>>"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    gaps = lambda s, i: F.array(*[F.when(cond, F.concat(F.lit("Strategy "), i.cast("string"), F.lit(f" missing {c}"))) for c, cond in (("name", _absent(s["name"])), ("description", _absent(s["description"])), ("prerequisite_actions", empty(s["prerequisite_actions"])), ("assumptions", empty(s["assumptions"])))])
    when = lambda cond, text: F.array(F.when(F.coalesce(cond, F.lit(False)), text))
    long = lambda c, most: when(F.length(c) > most, F.concat(F.lit(f"{c} too long ("), F.length(c).cast("string"), F.lit(f" > {most})")))
    texts = [when(_absent(F.col(c)), F.lit(f"{c} is required")) for c in ("problem_statement", "root_cause_hypothesis", "risk_explanation")]
    texts += [when(F.size(strategies) < 2, F.lit("Must have >= 2 suggested strategies")), F.flatten(F.transform(strategies, gaps))]
    texts += [when((F.col("confidence") < 60) & _absent(F.col("confidence_explanation")), F.lit("Low confidence (<60%) requires explanation"))]
    texts += [when(F.col("requires_human_decision") & _absent(F.col("decision_required_for")), F.lit("If requires_human_decision, must specify decision_required_for"))]
    texts += [long("problem_statement", 500), long("risk_explanation", 1000), long("root_cause_hypothesis", 500)]
    return F.array_compact(F.concat(*texts))


def group_hits(hits: DataFrame) -> DataFrame:
    """Findings of hits (repo_id, rule_id, path, line_no): one for each repository and rule, files with their range of lines and more than 3 hits HIGH."""
    per = hits.groupBy("repo_id", "rule_id", "path").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.count("*").alias("n"))
    file = F.struct("path", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("line_range"), file_severity().alias("severity"))
    out = per.groupBy("repo_id", "rule_id").agg(F.sort_array(F.collect_list(file)).alias("affected_files"), F.sum("n").alias("hits"))
    return out.withColumn("problem_statement", F.concat(F.col("hits").cast("string"), F.lit(" hits of "), "rule_id"))


def file_severity(n: str = "n") -> Column:
    return F.when(F.col(n) > 3, "HIGH").otherwise("MEDIUM")


def capped_files(findings: DataFrame, most: int = 5) -> DataFrame:
    """(id, place, path): the first files of each finding and, if there are more, one row that says how many."""
    files = F.col("affected_files")
    shown = F.transform(F.slice(files, 1, most), lambda f: f["path"])
    rest = F.when(F.size(files) > most, F.array(F.concat(F.lit("... and "), (F.size(files) - most).cast("string"), F.lit(" more files")))).otherwise(F.array().cast("array<string>"))
    return findings.select("id", F.posexplode(F.concat(shown, rest)).alias("place", "path"))


def conflict_key() -> Column:
    return F.concat_ws("|", F.array_join(F.slice(F.transform("affected_files", lambda f: f["path"]), 1, 3), ","), F.substring("problem_statement", 1, 50))


def conflicts(findings: DataFrame, by: str = "repo_id") -> DataFrame:
    """(id, n_others, first_other): findings of one repository (or run) that share a key, with how many others do and the
    smallest other id. No group is gathered: its smallest id and the smallest after it are two minima."""
    keyed = cut(findings.select("id", F.struct(by, conflict_key().alias("key")).alias("key")))
    per = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n > 1")
    own = keyed.join(per, "key")
    second = own.where("id <> a").groupBy("key").agg(F.min("id").alias("b"))
    return own.join(second, "key").select("id", (F.col("n") - 1).alias("n_others"), F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("first_other"))


def conflict_groups(findings: DataFrame, by: str = "repo_id") -> DataFrame:
    """(id, conflicts): the sorted ids of the other findings of the repository (or run) with the same key. The lists hold
    what a group has, so they grow with the square of its size; conflicts() counts without them."""
    keyed = cut(findings.select("id", F.struct(by, conflict_key().alias("key")).alias("key")))
    ids = keyed.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    return keyed.join(ids, "key").select("id", F.array_except("ids", F.array("id")).alias("conflicts"))


def counts(findings: DataFrame) -> DataFrame:
    """(kind, value, findings): by severity and by class, those that occur."""
    by = lambda kind, col: findings.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("findings")).select(F.lit(kind).alias("kind"), "value", "findings")
    return by("severity", "severity").union(by("bug_class", "bug_class"))


def run_summary(findings: DataFrame, skipped: int = 0) -> DataFrame:
    """One row: findings, repositories, those of each severity, members of conflict groups, analyzers that were skipped."""
    n = findings.agg(F.count("*").alias("findings"), F.count_distinct("repo_id").alias("repositories"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    c = conflicts(findings).agg(F.count("*").alias("conflicts"))
    return n.join(c).withColumn("skipped", F.lit(skipped))  # one row each


def overview(findings: DataFrame) -> DataFrame:
    """Total, severities, average confidence in per cent to one place, findings under 60 per cent."""
    sums = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    return findings.agg(F.count("*").alias("total"), *sums, F.round(F.avg("confidence"), 1).alias("average_confidence"), F.count_if(F.col("confidence") < 60).alias("low_confidence"))


def first_path() -> Column:
    return F.coalesce(F.try_element_at("affected_files", F.lit(1))["path"], F.lit(""))


def first_line() -> Column:
    """First number of the first file's range; 0 if there is none."""
    return F.coalesce(F.substring_index(F.try_element_at("affected_files", F.lit(1))["line_range"], "-", 1).try_cast("int"), F.lit(0))


def order_key() -> list[Column]:
    return [first_path().alias("first_path"), first_line().alias("first_line"), F.col("bug_class")]


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.select("id", *order_key()).orderBy("first_path", "first_line", "bug_class", "id")


def _reliability() -> Column:
    return F.coalesce(F.col("bug_class").isin(*RELIABILITY), F.lit(False))


def _n_files() -> Column:
    return F.greatest(F.size("affected_files"), F.lit(0))


def risk_points() -> Column:
    """Sum of doubles in this order: class, files (none counts as two or three), severity, statement, strategies; a critical reliability
    finding has 0.7 at least before the statement."""
    n, size = _n_files(), F.length("problem_statement")
    p = F.lit(0.0) + F.when(_reliability(), 0.3).otherwise(0.0)
    p = p + F.when(n == 1, 0.0).when(n <= 3, 0.3).otherwise(0.6)
    p = p + F.when(F.col("severity") == "CRITICAL", 0.4).when(F.col("severity") == "HIGH", 0.2).when(F.col("severity") == "MEDIUM", 0.1).otherwise(0.0)
    p = F.when(_reliability() & (F.col("severity") == "CRITICAL"), F.greatest(p, F.lit(0.7))).otherwise(p)
    p = p + F.when(size < 100, 0.0).when(size < 300, 0.2).otherwise(0.4)
    return p + F.when(F.col("n_strategies") > 3, 0.2).otherwise(0.0)


def _known_pattern() -> Column:
    return _reliability() & F.coalesce(F.col("severity").isin("CRITICAL", "HIGH"), F.lit(False))


def risk_level(points: Column) -> Column:
    return F.when(points < 0.3, "LOW").when(points < 0.7, "MEDIUM").otherwise("HIGH")


def risk_confidence(level: Column) -> Column:
    """By level, and 0.15 more for critical and high reliability findings, up to 0.95."""
    base = F.when(level == "LOW", 0.8).when(level == "MEDIUM", 0.7).otherwise(0.6)
    return F.when(_known_pattern(), F.least(F.lit(0.95), base + 0.15)).otherwise(base)


def risks(findings: DataFrame) -> DataFrame:
    """(id, points, risk_level, risk_confidence)."""
    t = findings.withColumn("points", risk_points()).withColumn("risk_level", risk_level(F.col("points")))
    return t.select("id", "points", "risk_level", risk_confidence(F.col("risk_level")).alias("risk_confidence"))


def risk_factors(findings: DataFrame) -> DataFrame:
    """(id, factors): what the risk assessment looked at, in its order."""
    n, size, text = _n_files(), F.length("problem_statement"), lambda c, tail: F.concat(c.cast("string"), F.lit(tail))
    s = F.col("severity")
    texts = [
        F.when(_reliability(), "reliability bug (production-critical)"), F.when(n == 1, "single file").when(n <= 3, text(n, " files")).otherwise(text(n, " files (multi-file)")),
        F.when(s == "CRITICAL", "critical severity").when(s == "HIGH", "high severity").when(s == "MEDIUM", "medium severity").otherwise("low severity"),
        F.when(size < 100, "small change").when(size < 300, "medium change").otherwise("large change"), F.when(F.col("n_strategies") > 3, text(F.col("n_strategies"), " strategies (complex)")),
        F.when(_known_pattern(), "high confidence (known reliability pattern)"),
    ]
    return findings.select("id", F.array_compact(F.array(*texts)).alias("factors"))


def candidates(findings: DataFrame) -> DataFrame:
    """Fix candidates of the findings that name a file, as they are stored: explanation with up to 3 strategies, patch and fixed
    code of the first one, risk level and the risk assessment's confidence in per cent; line is always 0, as in the stored form."""
    own = findings.where(F.size("affected_files") > 0).withColumn("risk_level", risk_level(risk_points()))
    first = F.try_element_at("suggested_strategies", F.lit(1))["description"]
    some = F.size("suggested_strategies") > 0
    span = F.when(_absent(F.element_at("affected_files", 1)["line_range"]), "1").otherwise(F.element_at("affected_files", 1)["line_range"])
    old = F.when(_absent(F.col("risk_explanation")), "# existing code").otherwise(F.substring("risk_explanation", 1, 100))
    patch = F.concat(F.lit("--- a/"), first_path(), F.lit("\n+++ b/"), first_path(), F.lit("\n@@ -"), span, F.lit(",1 +"), span, F.lit(",1 @@\n-"), old, F.lit("\n+# Fixed: "), F.substring(F.coalesce(first, F.lit("")), 1, 100), F.lit("\n"))
    listed = F.transform(F.slice("suggested_strategies", 1, 3), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(s["name"], F.lit("")), F.lit(": "), F.substring(F.coalesce(s["description"], F.lit("")), 1, 200)))
    explanation = F.concat(F.lit("Problem: "), F.coalesce("problem_statement", F.lit("")), F.when(some, F.concat(F.lit("\n\nProposed Strategies:\n"), F.array_join(listed, "\n"))).otherwise(""))
    fixed = F.when(some, F.concat(F.lit("# Proposed fix: "), F.coalesce(first, F.lit("")))).otherwise("# Fix to be determined")
    return own.select(
        "id", first_path().alias("file_path"), F.lit(0).alias("line"), F.coalesce("risk_explanation", F.lit("")).alias("original_code"), fixed.alias("fixed_code"), explanation.alias("explanation"), patch.alias("patch"), F.lit("proposed").alias("status"),
        "risk_level", F.floor(risk_confidence(F.col("risk_level")) * 100).cast("int").alias("confidence"), "bug_class", first_line().alias("first_line"),
    )


def dedup_candidates(cands: DataFrame) -> DataFrame:
    """The first candidate, in finding order, of each sha256(file:line:finding)."""
    key = F.sha2(F.concat_ws(":", "file_path", F.col("line").cast("string"), F.col("id").cast("string")), 256)
    keyed = cands.withColumn("key", key)
    return keyed.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("file_path", "first_line", "bug_class"))).where("rank = 1").select("id", "file_path", "key")


def risk_distribution(levels: DataFrame) -> DataFrame:
    r = or_default("risk_level", "MEDIUM")
    return levels.agg(*[F.count_if(r == x).alias(x.lower()) for x in ("LOW", "MEDIUM", "HIGH")])


def evidence_confidence(evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, calibrated): the floor of the mean weight of the sources of evidence (id, source), less 10 for each of the conflicts (id), 0 to
    100. A null source is no evidence: 50 where there is no other, whatever the conflicts."""
    weight = F.lit(None).cast("int")
    for source, w in EVIDENCE_WEIGHT.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    per = evidence.withColumn("w", weight).groupBy("id").agg(F.sum("w").alias("s"), F.count("w").alias("n"))
    t = per.join(conflicts.groupBy("id").agg(F.count("*").alias("c")), "id", "left")
    base = F.floor(F.col("s") / F.col("n")) - 10 * F.coalesce("c", F.lit(0))
    return t.select("id", F.when(F.col("n") == 0, 50).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), base))).cast("int").alias("calibrated"))


def band(c: Column) -> Column:
    """What a confidence means, in a sentence."""
    out = F.lit(BANDS[-1][1])
    for low, name in reversed(BANDS):
        out = F.when(c >= low, name).otherwise(out)
    return out


def assessments(evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, calibrated, explanation) of evidence (id, at, source, detail) and conflicts (id, at, detail): the evidence in order of at, then the
    conflicts, then the sentence of the calibrated confidence."""
    listed = lambda line: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n")
    own = evidence.where(F.col("source").isNotNull()).groupBy("id").agg(listed(F.concat(F.lit("  - "), "source", F.lit(": "), F.coalesce("detail", F.lit("")))).alias("own"))
    other = conflicts.groupBy("id").agg(listed(F.concat(F.lit("  - "), F.coalesce("detail", F.lit("")))).alias("other"))
    t = evidence_confidence(evidence, conflicts).join(own, "id", "left").join(other, "id", "left")
    against = F.when(F.col("other").isNotNull(), F.concat(F.lit("\n\nConflicting evidence:\n"), "other")).otherwise("")
    text = F.when(F.col("own").isNull(), "No evidence collected. Confidence score is neutral.").otherwise(F.concat(F.lit("Supporting evidence:\n"), "own", against, F.lit("\n\nOverall: "), band(F.col("calibrated"))))
    return t.select("id", "calibrated", text.alias("explanation"))


def adjusted_severity(severity: Column, confidence: Column) -> Column:
    """One level down under 40, to LOW at least and from anything unknown; CRITICAL to HIGH under 60."""
    down = F.when(severity == "CRITICAL", "HIGH").when(severity == "HIGH", "MEDIUM").otherwise("LOW")
    return F.when(confidence < 40, down).when((confidence < 60) & (severity == "CRITICAL"), "HIGH").otherwise(severity)


def risk_score(severity: Column, confidence: Column) -> Column:
    w = F.lit(50)
    for s, x in SEVERITY_WEIGHT.items():
        w = F.when(severity == s, x).otherwise(w)
    return F.least(F.lit(100), F.floor(w * confidence / 100)).cast("int")


def classify(issues: DataFrame, rules: DataFrame, code: str = "issue_code") -> DataFrame:
    """safety, score and title of each issue by rules (issue_code, safety, score, title), SAFE before RISKY where a code is in both; SUGGEST and 0 for the others."""
    best = rules.groupBy("issue_code").agg(F.min_by(F.struct("safety", "score", "title"), ranked("safety", ("SAFE", "RISKY"))).alias("r"))
    joined = issues.join(best.withColumnRenamed("issue_code", "rule_code"), F.col(code) == F.col("rule_code"), "left").drop("rule_code")
    return joined.select(*issues.columns, F.coalesce("r.safety", F.lit("SUGGEST")).alias("safety"), F.coalesce("r.score", F.lit(0)).alias("rule_score"), F.coalesce("r.title", F.concat(F.lit("Rule "), F.col(code))).alias("title"))


def category_summary(classified: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("safety") == s)
    return classified.agg(F.count("*").alias("total"), n("SAFE").alias("safe"), n("RISKY").alias("risky"), n("SUGGEST").alias("suggest"), n("SAFE").alias("auto_fixable"))


def fix_plan(classified: DataFrame, mode: str) -> DataFrame:
    """(issue_code, action, issues): safe issues are fixed, risky ones reviewed (fixed too if mode is all), others suggested."""
    risky = "fix" if mode == "all" else "review"
    action = F.when(F.col("safety") == "SAFE", "fix").when(F.col("safety") == "RISKY", risky).otherwise("suggest")
    return classified.groupBy("issue_code", action.alias("action")).agg(F.count("*").alias("issues"))


def recategorize(results: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, category, is_fixed): the issues whose stored category or state changes: SAFE becomes safe and fixed, RISKY review, others suggestion."""
    c = classify(results, rules)
    cat = F.when(F.col("safety") == "SAFE", "safe").when(F.col("safety") == "RISKY", "review").otherwise("suggestion")
    fixed = F.when(F.col("safety") == "SAFE", 1).otherwise(F.col("is_fixed"))
    t = c.withColumns({"new_category": cat, "new_fixed": fixed})
    changed = ~(F.col("new_category").eqNullSafe(F.col("category")) & F.col("new_fixed").eqNullSafe(F.col("is_fixed")))
    return t.where(changed).select("id", F.col("new_category").alias("category"), F.col("new_fixed").alias("is_fixed"))


def categorize_js(issues: DataFrame, safe: tuple[str, ...], review: tuple[str, ...], code: str = "issue_code") -> DataFrame:
    return issues.withColumn("category", F.when(F.col(code).isin(*safe), "safe").when(F.col(code).isin(*review), "review").otherwise("suggestion"))


def explain(issues: DataFrame, texts: DataFrame, code: str = "issue_code") -> DataFrame:
    """Title, description, reason, impact and safety score of each issue's rule by texts (issue_code, title, description, why_safe, impact,
    safety_score), or the default ones."""
    fields = ("title", "description", "why_safe", "impact", "safety_score")
    given = texts.select(F.col("issue_code").alias("_code"), F.struct(*fields).alias("_text"))
    default = [F.concat(F.lit(NO_EXPLANATION[0]), F.col(code)), *map(F.lit, NO_EXPLANATION[1:])]
    none = F.col("_text").isNull()
    return issues.join(given, F.col(code) == F.col("_code"), "left").select(*issues.columns, *[F.when(none, d).otherwise(F.col(f"_text.{f}")).alias(f) for f, d in zip(fields, default, strict=True)])


def batch_validation(batches: DataFrame, fixes: DataFrame, operation: str) -> DataFrame:
    """Of batches (batch_id, fix_id): the fixes found, their files, duplicate and missing ids, fixes in a state the operation does not
    take, files that several fixes touch (for apply: warnings, which leave a batch valid), the highest risk, the number of fixes in each
    of STATUSES, and whether the batch is valid: at least one fix found and no error."""
    allowed = TRANSITIONS[operation][0]
    per_id = batches.groupBy("batch_id", "fix_id").agg(F.count("*").alias("times"))
    j = per_id.join(fixes.select(F.col("id").alias("fix_id"), "file_path", "status", "risk_level"), "fix_id", "left")
    known = F.col("status").isNotNull()
    high = F.max(F.when(F.col("risk_level") == "HIGH", 3).when(F.col("risk_level") == "MEDIUM", 2).when(F.col("risk_level") == "LOW", 1).otherwise(0))
    out = j.groupBy("batch_id").agg(
        F.count_if(known).alias("size"), F.count_distinct(F.when(F.col("file_path") != "", F.col("file_path"))).alias("files"), F.count_if(F.col("times") > 1).alias("duplicates"), F.count_if(~known).alias("missing"),
        F.count_if(known & ~F.col("status").isin(*allowed)).alias("wrong_state"), high.alias("h"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
    )
    clash = batch_conflicts(batches, fixes).groupBy("batch_id").agg(F.count("*").alias("n"))
    t = out.join(clash, "batch_id", "left").withColumn("warnings", F.coalesce("n", F.lit(0)) if operation == "apply" else F.lit(0).cast("long"))
    risk = F.when(F.col("h") == 3, "HIGH").when(F.col("h") == 2, "MEDIUM").otherwise("LOW")
    valid = (F.col("size") > 0) & (F.col("duplicates") == 0) & (F.col("missing") == 0) & (F.col("wrong_state") == 0)
    return t.select("batch_id", "size", "files", "duplicates", "missing", "wrong_state", "warnings", risk.alias("risk_level"), *STATUSES, valid.alias("valid"))


def batch_conflicts(batches: DataFrame, fixes: DataFrame) -> DataFrame:
    """(batch_id, file_path, fixes): files that more than one fix of a batch touches."""
    j = batches.select("batch_id", "fix_id").distinct().join(fixes.where("file_path <> ''").select(F.col("id").alias("fix_id"), "file_path"), "fix_id")
    return j.groupBy("batch_id", "file_path").agg(F.count("*").alias("fixes")).where("fixes > 1")


def transitions(requests: DataFrame, fixes: DataFrame) -> DataFrame:
    """Outcome of requests (request_id, fix_id, operation, actor, at, can): the new status, or an error code. The plan is looked at
    first, then whether there is such a fix, then its state; a fix that is not approved fails the validation before it is applied."""
    j = requests.join(fixes.select(F.col("id").alias("fix_id"), "status"), "fix_id", "left")
    allowed, target = F.lit(False), F.lit(None).cast("string")
    for op, (states, new) in TRANSITIONS.items():
        allowed = allowed | ((F.col("operation") == op) & F.col("status").isin(*states))
        target = F.when(F.col("operation") == op, new).otherwise(target)
    error = F.when(~F.col("can"), "plan_restriction").when(F.col("status").isNull(), "not_found").when(~allowed, F.when(F.col("operation") == "apply", "validation_failed").otherwise("invalid_state"))
    t = j.withColumn("error", error)
    ok = F.col("error").isNull()
    return t.select("request_id", "fix_id", F.when(ok, target).otherwise(F.col("status")).alias("status"), F.when(ok, F.col("actor")).alias("actor"), F.when(ok, F.col("at")).alias("at"), "error")


def batch_outcomes(outcomes: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_id, total, succeeded, failed) of transitions by the batch of their fix."""
    j = batches.select("batch_id", "fix_id").distinct().join(outcomes, "fix_id")
    return j.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@F.pandas_udf(T.StringType())
def unified_patch(original: pd.Series, fixed: pd.Series, path: pd.Series) -> pd.Series:
    """The unified difference of two texts, under the names a/path and b/path, its lines ended as theirs are."""

    def one(a: str, b: str, name: str) -> str:
        return "".join(difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), f"a/{name}", f"b/{name}", lineterm=""))

    return pd.Series([None if a is None or b is None else one(a, b, n) for a, b, n in zip(original, fixed, path, strict=True)], dtype=object)


def combined_patches(batches: DataFrame, fixes: DataFrame) -> DataFrame:
    """(batch_id, patch): the patches of a batch's fixes (id, file_path, patch, original_code, fixed_code) in order of path, id, each under a
    header and before a blank line. A fix without a patch has the difference of its codes; one that has not both is left out."""
    path = lambda other: F.when(_absent(F.col("file_path")), other).otherwise(F.col("file_path"))
    own = fixes.where(~_absent(F.col("patch")) | ~(_absent(F.col("original_code")) | _absent(F.col("fixed_code"))))
    stored, made = own.where(~_absent(F.col("patch"))), own.where(_absent(F.col("patch"))).withColumn("patch", unified_patch("original_code", "fixed_code", path("file")))
    both = stored.unionByName(made).select(F.col("id").alias("fix_id"), F.coalesce("file_path", F.lit("")).alias("path"), path("unknown").alias("name"), "patch")
    j = batches.select("batch_id", "fix_id").distinct().join(both, "fix_id")
    per = j.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("path", "fix_id", "name", "patch"))).alias("ps"))
    return per.select("batch_id", F.array_join(F.transform("ps", lambda p: F.concat(F.lit("# Fix #"), p["fix_id"].cast("string"), F.lit(": "), p["name"], F.lit("\n"), p["patch"], F.lit("\n"))), "\n").alias("patch"))


def batch_preview(patches: DataFrame, validity: DataFrame) -> DataFrame:
    """(batch_id, sha256, size) of the combined patch; without hash and of size 0 where the batch is not valid."""
    j = validity.select("batch_id", "valid").join(patches, "batch_id", "left")
    text = F.when(F.col("valid"), F.coalesce("patch", F.lit("")))
    return j.select("batch_id", F.sha2(text, 256).alias("sha256"), F.coalesce(F.length(text), F.lit(0)).alias("size"))


def validate_fixes(fixes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, errors, warning) of fixes (id, repo_id, status, file_path, original_code, fixed_code) against the current files (repo_id, path,
    content): every error in order, and the warning, if any. The whole file has to equal the original code; white space at the ends
    alone gives a warning. A file and an original text that several fixes name are compared once."""
    trimmed = lambda c: F.regexp_replace(c, r"^[\s\x1c-\x1f\x85\u00a0\u2028\u2029]+|[\s\x1c-\x1f\x85\u00a0\u2028\u2029]+$", "")
    wanted = fixes.where("file_path <> ''").select("repo_id", "file_path", "original_code").distinct()
    content, code = F.col("content"), F.coalesce("original_code", F.lit(""))
    found = wanted.join(files.select("repo_id", F.col("path").alias("file_path"), "content"), ["repo_id", "file_path"])
    found = found.select(F.col("repo_id").alias("r"), F.col("file_path").alias("p"), F.col("original_code").alias("c"), F.lit(True).alias("known"), (content == code).alias("same"), (trimmed(content) == trimmed(code)).alias("near"))
    j = fixes.join(found, (F.col("repo_id") == F.col("r")) & (F.col("file_path") == F.col("p")) & F.col("original_code").eqNullSafe(F.col("c")), "left")
    state = F.when(F.coalesce("status", F.lit("")) != "approved", F.concat(F.lit("not approved: "), F.coalesce("status", F.lit(""))))
    file = F.when(_absent(F.col("file_path")), "no path").when(F.col("known").isNull(), "file not found").when(~F.col("near"), "content changed")
    errors = F.array_compact(F.array(state, file))
    warnings = F.array_compact(F.array(F.when(~F.col("same") & F.col("near"), "white space differs"), F.when((F.size(errors) == 0) & F.col("original_code").eqNullSafe(F.col("fixed_code")), "patch is empty")))
    return j.select("id", errors.alias("errors"), warnings.alias("warnings"))


def allowed_analyzers(wanted: DataFrame, bridge: DataFrame) -> DataFrame:
    """(plan, analyzer_id, allowed, reason) of wanted (plan, analyzer_id) by the bridge (plan, analyzer_id)."""
    j = wanted.join(bridge.select("plan", "analyzer_id").distinct().withColumn("ok", F.lit(True)), ["plan", "analyzer_id"], "left")
    ok = F.coalesce("ok", F.lit(False))
    return j.select("plan", "analyzer_id", ok.alias("allowed"), F.when(~ok, F.concat(F.lit("not in plan "), F.col("plan"))).alias("reason"))


def plan_cutoff(analyzers: DataFrame, plan: str) -> DataFrame:
    """The analyzers (analyzer_id, min_plan) that a plan includes, by the order of plans."""
    return analyzers.where(ranked("min_plan", PLANS) <= PLANS.index(plan)).select("analyzer_id", "min_plan")


def selection_errors(selections: DataFrame, analyzers: DataFrame, *by: str) -> DataFrame:
    """(by, plan, analyzer_id, error) of selections (by, plan, analyzer_id), by naming who selects: unknown plan, duplicate,
    unknown id, plan too low."""
    per = selections.groupBy(*by, "plan", "analyzer_id").agg(F.count("*").alias("n"))
    j = per.join(analyzers, "analyzer_id", "left")
    rank, need = ranked("plan", PLANS, -1), ranked("min_plan", PLANS)
    errors = [F.when(rank < 0, "unknown plan"), F.when(F.col("n") > 1, "duplicate"), F.when(F.col("min_plan").isNull(), "unknown analyzer"), F.when((rank >= 0) & (rank < need) & F.col("min_plan").isNotNull(), "plan too low")]
    return j.select(*by, "plan", "analyzer_id", F.explode(F.array_compact(F.array(*errors))).alias("error"))


def locked_services(required: DataFrame, owned: DataFrame) -> DataFrame:
    """(plan, service): required (plan, service) that are not owned."""
    return required.distinct().join(owned, ["plan", "service"], "left_anti").orderBy("plan", "service")


def coverage(selected: DataFrame, executed: DataFrame, bridge: DataFrame) -> DataFrame:
    """(run_id, executed, locked, skipped): counts of a run's selected (run_id, plan, analyzer_id) that ran (run_id, analyzer_id), that the plan locks, and that did not run though allowed."""
    j = selected.join(executed.distinct().withColumn("ran", F.lit(True)), ["run_id", "analyzer_id"], "left").join(bridge.select("plan", "analyzer_id").distinct().withColumn("ok", F.lit(True)), ["plan", "analyzer_id"], "left")
    ran, ok = F.col("ran").isNotNull(), F.col("ok").isNotNull()
    return j.groupBy("run_id").agg(F.count_if(ran).alias("executed"), F.count_if(~ran & ~ok).alias("locked"), F.count_if(~ran & ok).alias("skipped"))


def quotas(runs: DataFrame, repositories: DataFrame, limits: DataFrame) -> DataFrame:
    """(installation_id, month, runs, repositories, over) of installations against limits (plan, max_runs, max_repositories; null: none); plans go by installation_id modulo 3."""
    own = runs.join(repositories.select(F.col("id").alias("repository_id"), "installation_id"), "repository_id")
    per = own.groupBy("installation_id", F.date_trunc("month", "created_at").alias("month")).agg(F.count("*").alias("runs"), F.count_distinct("repository_id").alias("repositories"))
    plan = F.when(F.col("installation_id") % 3 == 0, PLANS[0]).when(F.col("installation_id") % 3 == 1, PLANS[1]).otherwise(PLANS[2])
    j = per.withColumn("plan", plan).join(limits, "plan")
    over = (F.col("runs") > F.col("max_runs")) | (F.col("repositories") > F.col("max_repositories"))
    return j.select("installation_id", "month", "plan", "runs", "repositories", F.coalesce(over, F.lit(False)).alias("over"))
