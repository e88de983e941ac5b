"""Findings, fixes and replays by cases worked out by hand."""

import hashlib
import json

from pyspark.sql import functions as F

from tallywright.operators import findings as fd
from tallywright.operators import ledger, reliability

FINDING = "id long, bug_class string, severity string, confidence int, problem_statement string, affected_files array<struct<path: string, line_range: string, severity: string>>, n_strategies int, risk_explanation string, suggested_strategies array<struct<name: string, description: string, prerequisite_actions: array<string>, assumptions: array<string>>>"
WAY = lambda n, d="do it": (n, d, ["read"], ["none"])


def finding(spark, **given):
    base = {"id": 1, "bug_class": "god_objects", "severity": "LOW", "confidence": 90, "problem_statement": "short", "affected_files": [("a.py", "10-20", "LOW")], "n_strategies": 2, "risk_explanation": "risk", "suggested_strategies": [WAY("one"), WAY("two")]} | given
    return spark.createDataFrame([tuple(base[c.split(" ")[0]] for c in ("id", "bug_class", "severity", "confidence", "problem_statement", "affected_files", "n_strategies", "risk_explanation", "suggested_strategies"))], FINDING)


def risk(spark, **given):
    r = fd.risks(finding(spark, **given)).first()
    return round(r["points"], 6), r["risk_level"], round(r["risk_confidence"], 6)


def test_risk(spark):
    assert risk(spark) == (0.0, "LOW", 0.8)
    assert risk(spark, affected_files=[]) == (0.3, "MEDIUM", 0.7)  # no file counts as two or three
    assert risk(spark, affected_files=[(f"{i}.py", None, "LOW") for i in range(4)]) == (0.6, "MEDIUM", 0.7)
    assert risk(spark, bug_class="crash_risks", severity="CRITICAL") == (0.7, "HIGH", 0.75)
    assert risk(spark, bug_class="reliability_other", severity="CRITICAL", confidence=99) == (0.4, "MEDIUM", 0.7)  # not one of the classes
    assert risk(spark, bug_class="resource_leaks", severity="HIGH") == (0.5, "MEDIUM", 0.85)
    assert risk(spark, bug_class="resource_leaks", severity="LOW") == (0.3, "MEDIUM", 0.7)
    assert risk(spark, problem_statement="x" * 300, n_strategies=4) == (0.6, "MEDIUM", 0.7)
    got = fd.risk_factors(finding(spark, bug_class="crash_risks", severity="CRITICAL", affected_files=[(f"{i}", None, None) for i in range(4)], problem_statement="x" * 100, n_strategies=5)).first()["factors"]
    assert got == ["reliability bug (production-critical)", "4 files (multi-file)", "critical severity", "medium change", "5 strategies (complex)", "high confidence (known reliability pattern)"]
    assert fd.risk_factors(finding(spark)).first()["factors"] == ["single file", "low severity", "small change"]


def test_candidate(spark):
    r = fd.candidates(finding(spark, suggested_strategies=[WAY(f"w{i}", f"d{i}" * 60) for i in range(5)])).first()
    assert r["patch"] == "--- a/a.py\n+++ b/a.py\n@@ -10-20,1 +10-20,1 @@\n-risk\n+# Fixed: " + ("d0" * 60)[:100] + "\n"
    assert r["explanation"] == "Problem: short\n\nProposed Strategies:\n" + "\n".join(f"{i + 1}. w{i}: " + f"d{i}" * 60 for i in range(3))
    assert (r["fixed_code"], r["risk_level"], r["confidence"], r["status"], r["original_code"]) == ("# Proposed fix: " + "d0" * 60, "LOW", 80, "proposed", "risk")
    r = fd.candidates(finding(spark, suggested_strategies=[], risk_explanation=None, affected_files=[("b.py", None, "LOW")])).first()
    assert r["patch"] == "--- a/b.py\n+++ b/b.py\n@@ -1,1 +1,1 @@\n-# existing code\n+# Fixed: \n"
    assert (r["fixed_code"], r["explanation"], r["original_code"]) == ("# Fix to be determined", "Problem: short", "")
    assert fd.candidates(finding(spark, affected_files=[])).count() == 0


def test_validation(spark):
    full = finding(spark, risk_explanation="", suggested_strategies=[("n", "", [], ["a"])], confidence=59, problem_statement="p" * 501)
    full = full.withColumns({"root_cause_hypothesis": F.lit(None).cast("string"), "confidence_explanation": F.lit(""), "requires_human_decision": F.lit(True), "decision_required_for": F.lit("")})
    assert full.select(fd.validation_errors().alias("e")).first()["e"] == [
        "root_cause_hypothesis is required", "risk_explanation is required", "Must have >= 2 suggested strategies", "Strategy 0 missing description", "Strategy 0 missing prerequisite_actions",
        "Low confidence (<60%) requires explanation", "If requires_human_decision, must specify decision_required_for", "problem_statement too long (501 > 500)",
    ]


def test_assessment(spark):
    evidence = spark.createDataFrame([(1, 2, "heuristic", "b"), (1, 1, "static_pattern", "a"), (2, 1, "naming_convention", "n"), (3, 1, None, None)], "id int, at int, source string, detail string")
    against = spark.createDataFrame([(2, 1, "only in tests")], "id int, at int, detail string")
    got = {r["id"]: (r["calibrated"], r["explanation"]) for r in fd.assessments(evidence, against).collect()}
    assert got[1] == (82, "Supporting evidence:\n  - static_pattern: a\n  - heuristic: b\n\nOverall: High confidence: Evidence is strong and reliable.")
    assert got[2] == (40, "Supporting evidence:\n  - naming_convention: n\n\nConflicting evidence:\n  - only in tests\n\nOverall: Lower confidence: Evidence is based on heuristics; manual review recommended.")
    assert got[3] == (50, "No evidence collected. Confidence score is neutral.")
    s = spark.createDataFrame([("CRITICAL", 39), ("LOW", 39), ("INFO", 39), ("INFO", 41), ("CRITICAL", 59), ("CRITICAL", 60)], "s string, c int")
    assert [r[0] for r in s.select(fd.adjusted_severity(F.col("s"), F.col("c"))).collect()] == ["HIGH", "LOW", "LOW", "INFO", "HIGH", "CRITICAL"]


FIX = "id int, file_path string, status string, risk_level string, patch string, original_code string, fixed_code string"


def test_transitions(spark):
    fixes = spark.createDataFrame([(i, "a.py", s, "LOW", None, None, None) for i, s in enumerate(fd.STATUSES)], FIX)
    asked = spark.createDataFrame([(10 * i + k, i, op, "me", True) for i in range(8) for k, op in enumerate(("approve", "reject", "apply"))] + [(99, 50, "approve", "me", False)], "request_id int, fix_id int, operation string, actor string, can boolean").withColumn("at", F.current_timestamp())
    got = {(r["fix_id"], r["request_id"] % 10): (r["status"], r["error"]) for r in fd.transitions(asked, fixes).collect()}
    assert (got[0, 0], got[0, 1], got[6, 0], got[1, 2]) == (("approved", None), ("rejected", None), ("approved", None), ("applied", None))
    assert got[5, 0] == ("pending", "invalid_state") and got[1, 1] == ("approved", "invalid_state") and got[0, 2] == ("proposed", "validation_failed")
    assert got[7, 0] == (None, "not_found") and got[50, 9] == (None, "plan_restriction")  # the plan comes first


def test_batches(spark):
    fixes = spark.createDataFrame([(1, "b.py", "approved", "LOW", "+x", None, None), (2, "b.py", "approved", "HIGH", None, "a\n", "b\n"), (3, None, "approved", "LOW", "+z", None, None), (4, "a.py", "approved", "LOW", None, "a", None), (5, "c.py", "proposed", "LOW", "+q", None, None)], FIX)
    batches = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 5), (2, 5), (2, 77), (3, 78)], "batch_id int, fix_id int")
    valid = {r["batch_id"]: r for r in fd.batch_validation(batches, fixes, "apply").collect()}
    assert (valid[1]["valid"], valid[1]["size"], valid[1]["warnings"], valid[1]["files"], valid[1]["approved"]) == (True, 4, 1, 2, 4)  # two fixes of a file are a warning
    assert (valid[2]["valid"], valid[2]["size"], valid[2]["duplicates"], valid[2]["missing"], valid[2]["wrong_state"], valid[2]["proposed"]) == (False, 1, 1, 1, 1, 1)
    assert (valid[3]["valid"], valid[3]["size"]) == (False, 0)
    patches = fd.combined_patches(batches, fixes)
    text = {r["batch_id"]: r["patch"] for r in patches.collect()}
    assert text[1] == "# Fix #3: unknown\n+z\n\n# Fix #1: b.py\n+x\n\n# Fix #2: b.py\n--- a/b.py+++ b/b.py@@ -1 +1 @@-a\n+b\n\n"
    preview = {r["batch_id"]: (r["sha256"], r["size"]) for r in fd.batch_preview(patches, fd.batch_validation(batches, fixes, "apply")).collect()}
    assert preview == {1: (hashlib.sha256(text[1].encode()).hexdigest(), len(text[1])), 2: (None, 0), 3: (None, 0)}


def test_fixes_against_whole_files(spark):
    files = spark.createDataFrame([(1, "a.py", "f = 1\n"), (2, "a.py", "other")], "repo_id int, path string, content string")
    rows = [(1, 1, "approved", "a.py", "f = 1\n", "g"), (2, 2, "approved", "a.py", "f = 1\n", "g"), (3, 1, "approved", "a.py", "\tf = 1", "g"), (4, 1, "approved", "a.py", "f", "g"), (5, 1, "proposed", "b.py", "f", "g"), (6, 1, "approved", "", "f", "g"), (7, 1, "approved", "a.py", "f = 1\n", "f = 1\n"), (8, 3, "approved", "a.py", "f = 1\n", "g")]
    got = {r["id"]: (r["errors"], r["warnings"]) for r in fd.validate_fixes(spark.createDataFrame(rows, "id int, repo_id int, status string, file_path string, original_code string, fixed_code string"), files).collect()}
    assert got == {1: ([], []), 2: (["content changed"], []), 3: ([], ["white space differs"]), 4: (["content changed"], []), 5: (["not approved: proposed", "file not found"], []), 6: (["no path"], []), 7: ([], ["patch is empty"]), 8: (["file not found"], [])}


def test_decision_reports(spark):
    rows = [(1, "analyze", 9, 0, 9), (2, "fix", 10, 11, 0), (3, "fix", 10, 12, 2), (4, "fix", 60, 51, 9), (5, "fix", 10, 1, 9), (6, "fix", 60, 50, 10), (7, "fix", 60, 0, 60), (8, "fix", 1, 0, 1), (9, "fix", 0, 0, 0)]
    got = {r["run_id"]: (r["risk_level"], r["title"], r["confidence"]) for r in reliability.decision_reports(spark.createDataFrame(rows, "run_id int, mode string, before int, after int, fixed int")).collect()}
    assert got == {
        1: ("low", "Code analysis completed (preview mode)", 0.0), 2: ("high", "No issues were auto-fixed", 0.0), 3: ("high", "Fixed 2 issues (regressions detected)", 0.05), 4: ("medium", "Fixed 9 code issues", 0.15), 5: ("low", "Fixed 9 code issues", 0.9),
        6: ("medium", "Fixed 10 code issues", 0.17), 7: ("high", "Fixed 60 code issues", 1.0), 8: ("low", "Fixed 1 code issue", 1.0), 9: ("low", "No issues were auto-fixed", 1.0),
    }


def test_finding_events_keep_everything(spark):
    row = finding(spark).withColumn("run_id", F.lit("r")).withColumn("branch", F.lit("main"))
    payload = json.loads(ledger.finding_events(row).first()["payload"])
    assert payload["affected_files"] == ["a.py"] and payload["confidence"] == 0.9 and payload["metadata"]["branch"] == "main" and payload["constraints"] == dict.fromkeys(ledger.CONSTRAINTS, True)
    assert payload["suggested_strategies"] == [{"name": n, "description": "do it", "prerequisite_actions": ["read"], "assumptions": ["none"]} for n in ("one", "two")]
    assert payload["full_proposal"]["affected_files"] == [{"path": "a.py", "line_range": "10-20", "severity": "LOW"}]


EVENT = "id long, run_id string, sequence int, timestamp timestamp, event_type string, actor string, actor_role string, phase string, payload_ref string, summary string"


def events(spark, rows):
    return spark.createDataFrame([(i, run, seq, None, kind, "ann", role, "phase_1", ref, f"s{i}") for i, (run, seq, kind, role, ref) in enumerate(rows)], EVENT)


def test_replay_of_overrides_and_terminals(spark):
    e = events(spark, [("r", 0, "RUN_CREATED", None, None), ("r", 1, "RUN_ABORTED", "", None), ("r", 3, "OVERRIDE_SET", None, None), ("r", 4, "SAFETY_CHECK_PASSED", None, "p2"), ("r", 5, "SAFETY_CHECK_PASSED", None, "p1"), ("r", 6, "FIX_APPLIED", "", None), ("r", 7, "RUN_REJECTED", "Agent", None)])
    runs = spark.createDataFrame([("r", "repo", "legacy", None, None, "COMPLETE"), ("none", "repo", "", None, None, None)], "run_id string, repo_id string, run_policy_id string, started_at timestamp, ended_at timestamp, final_state string")
    r = {x["run_id"]: x for x in ledger.replay(e, runs).collect()}
    assert (r["r"]["overrides"], r["r"]["aborted"], r["r"]["rejected"], r["r"]["violations"]) == (2, True, True, 3)  # a gap and two terminal events
    assert (r["none"]["event_count"], r["none"]["violations"]) == (0, 0)
    texts = sorted(x["violation"] for x in ledger.violations(e, runs).collect())
    assert texts == ["sequence-gap-or-out-of-order: expected 2, found 3", "terminal-mismatch: ledger=COMPLETE event=RUN_ABORTED", "terminal-mismatch: ledger=COMPLETE event=RUN_REJECTED"]
    items = ledger.replay_items(e).first()
    assert items["policy_refs"] == ["p1", "p2"] and [x["actor"] for x in items["fixes"]] == ["ann"] and [x["event_type"] for x in items["overrides"]] == ["RUN_ABORTED", "RUN_REJECTED"]
    assert sorted(x["policy"] for x in ledger.policies(e, runs).collect()) == ["p1", "p2"]  # LEGACY in any case, and empty texts, do not count
