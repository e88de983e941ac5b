"""Queries over run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import scratch_dir
from ..operators import ledger
from ..sources import files, stores
from .registry import Registry
from .views import Views

REGISTRY = Registry()
add = REGISTRY.add
E_COLS = ("run_id", "sequence", "id", "event_type", "actor", "phase", "payload_ref")
LAST = "SELECT run_id, max_by(event_type, (sequence, id)) AS event_type FROM ledger_events GROUP BY run_id"
SECONDS = "epoch_us(ended_at - started_at) / 1e6"
TERMINAL = "('RUN_COMPLETED', 'RUN_ABORTED', 'RUN_REJECTED')"
AGREE = "(l.event_type = 'RUN_COMPLETED' AND r.final_state IN ('COMPLETE', 'COMPLETED') OR l.event_type = 'RUN_ABORTED' AND r.final_state IN ('ABORTED', 'INCOMPLETE') OR l.event_type = 'RUN_REJECTED' AND r.final_state = 'REJECTED')"
GAPS = "SELECT run_id, expected, found FROM (SELECT run_id, lag(sequence, 1, -1) OVER (PARTITION BY run_id ORDER BY sequence, id) + 1 AS expected, sequence AS found FROM ledger_events) WHERE expected <> found"
POLICIES = """SELECT DISTINCT run_id, policy FROM (SELECT run_id, run_policy_id AS policy FROM ledger_runs WHERE upper(run_policy_id) <> 'LEGACY' UNION ALL
SELECT run_id, payload_ref FROM ledger_events WHERE event_type = 'SAFETY_CHECK_PASSED' OR contains(event_type, 'POLICY')) WHERE policy <> ''"""
REPORT = "SELECT run_id, list(payload_ref ORDER BY sequence DESC, id DESC)[1] AS edr_id FROM ledger_events WHERE event_type = 'EDR_FINALIZED' GROUP BY run_id"
HUMAN = "count(*) FILTER (WHERE event_type = 'PLAN_APPROVED' AND lower(actor_role) = 'human')"


def written(v: Views, df, kind: str = "json"):
    """df as JSON files in the folder the cluster shares, and their path: logs as a source finds them."""
    path = scratch_dir(v.spark)
    (df.write.text if kind == "text" else df.write.json)(path)
    return path


def _src_events(v: Views):
    path = written(v, v.ledger_events.select(*[F.col(c).cast("string") for c in v.ledger_events.columns]))
    return files.ledger_events(v.spark, path).select("run_id", F.col("id").cast("long").alias("id"), "sequence", "event_type", "payload_ref")


def _src_runs(v: Views):
    path = written(v, v.ledger_runs.select(*[F.col(c).cast("string") for c in v.ledger_runs.columns]).select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value")).repartition("value"), "text")
    return v.spark.read.schema(files.HEADER).json(path).withColumns({c: F.try_to_timestamp(c) for c in ("started_at", "ended_at")}).select("run_id", "repo_id", "started_at", "ended_at", "final_state")


add("src_ledger_events", _src_events, "SELECT run_id, id, sequence, event_type, payload_ref FROM ledger_events")
add("src_ledger_runs", _src_runs, "SELECT run_id, repo_id, started_at, ended_at, final_state FROM ledger_runs")
add("src_tables", lambda v: v.analysis_runs.select("id", "repository_id", "status"), "SELECT id, repository_id, status FROM analysis_runs")
add("sink_ledger", lambda v: ledger.append(v.ledger_events, v.ledger_runs, _incoming(v)), """
WITH inc AS (SELECT 'run-' || CAST(o_custkey % 200 AS VARCHAR) AS run_id, o_orderkey AS id, 'ISSUE_DETECTED' AS event_type, repeat('x', CAST(900 + o_orderkey % 300 AS INT)) AS summary FROM orders),
last AS (SELECT run_id, max(sequence) AS m FROM ledger_events GROUP BY run_id)
SELECT i.run_id, i.id, coalesce(m, -1) + row_number() OVER (PARTITION BY i.run_id ORDER BY i.id) AS sequence, event_type, substr(summary, 1, 1000) AS summary
FROM inc i LEFT JOIN last ON last.run_id = i.run_id WHERE i.run_id NOT IN (SELECT run_id FROM ledger_runs WHERE ended_at IS NOT NULL)""")  # fmt: skip


EVENT = "run_id string, id long, sequence long, event_type string, summary string"


def _stored(v: Views):
    """The given log, and the incoming rows appended to it in two batches, the first of them twice: what is stored then."""
    log = stores.EventLog(v.spark, scratch_dir(v.spark), EVENT, buckets=8)
    log.load(0, v.ledger_events)
    odd = F.col("id") % 2 == 1
    log.append(1, _incoming(v).where(odd))
    log.append(2, _incoming(v).where(~odd))
    log.append(1, _incoming(v).where(odd))
    return log.read().select("version", *[x.split(" ")[0] for x in EVENT.split(", ")])


def _replayed_in_steps(v: Views):
    """Replay of states that three batches of events, by their sequence, were merged into one after another."""
    states = stores.KeyedTable(v.spark, scratch_dir(v.spark), ledger.REPLAY_STATE, ("run_id",), buckets=8)
    for k, step in enumerate(("sequence < 20", "sequence >= 20 AND sequence < 45", "sequence >= 45")):
        states.merge(k, ledger.fold(v.ledger_events.where(step)), ledger.fold_onto())
    return ledger.replayed(states.read(), v.ledger_runs)


add("sink_ledger_store", _stored, """
WITH inc AS (SELECT 'run-' || CAST(o_custkey % 200 AS VARCHAR) AS run_id, o_orderkey AS id, 'ISSUE_DETECTED' AS event_type, repeat('x', CAST(900 + o_orderkey % 300 AS INT)) AS summary, CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 2 END AS version FROM orders),
last AS (SELECT run_id, max(sequence) AS m, bool_or(event_type IN ('RUN_COMPLETED', 'RUN_ABORTED', 'RUN_REJECTED')) AS sealed FROM ledger_events GROUP BY run_id)
SELECT 0 AS version, run_id, id, sequence, event_type, summary FROM ledger_events
UNION ALL SELECT i.version, i.run_id, i.id, coalesce(m, -1) + row_number() OVER (PARTITION BY i.run_id ORDER BY i.version, i.id), i.event_type, substr(summary, 1, 1000)
FROM inc i LEFT JOIN last ON last.run_id = i.run_id WHERE NOT coalesce(sealed, false)""")


def _incoming(v: Views):
    return v.orders.select(
        F.concat(F.lit("run-"), (F.col("o_custkey") % 200).cast("string")).alias("run_id"), F.col("o_orderkey").alias("id"), F.lit("ISSUE_DETECTED").alias("event_type"),
        F.repeat(F.lit("x"), (900 + F.col("o_orderkey") % 300).cast("int")).alias("summary"),
    )


add("sink_report", lambda v: files.report_json(ledger.replay(v.ledger_events, v.ledger_runs), "run_id"))
add("led_timeline", lambda v: ledger.timeline(v.ledger_events).select(*E_COLS), f"SELECT {', '.join(E_COLS)} FROM ledger_events")
add("led_duration", lambda v: ledger.durations(v.ledger_runs), f"SELECT run_id, {SECONDS} AS duration_seconds FROM ledger_runs")
add("led_human_approvals", lambda v: ledger.human_approvals(v.ledger_events), f"SELECT run_id, {HUMAN} AS human_approvals FROM ledger_events GROUP BY run_id")
add("led_policies", lambda v: ledger.policies(v.ledger_events, v.ledger_runs), POLICIES)
add("led_edr_id", lambda v: ledger.last_report(v.ledger_events), REPORT)
add("led_summary", lambda v: ledger.summary(v.ledger_events, v.ledger_runs), f"""
SELECT r.run_id, started_at, ended_at, {SECONDS} AS duration_seconds, final_state, coalesce(event_count, 0) AS event_count, coalesce(fixes_count, 0) AS fixes_count,
  coalesce(human_approvals, 0) AS human_approvals, coalesce(policies, '') AS policies, edr_id FROM ledger_runs r
LEFT JOIN (SELECT run_id, count(*) AS event_count, count(*) FILTER (WHERE event_type = 'FIX_APPLIED') AS fixes_count, {HUMAN} AS human_approvals FROM ledger_events GROUP BY run_id) c ON c.run_id = r.run_id
LEFT JOIN (SELECT run_id, string_agg(policy, ',' ORDER BY policy) AS policies FROM ({POLICIES}) GROUP BY run_id) p ON p.run_id = r.run_id LEFT JOIN ({REPORT}) e ON e.run_id = r.run_id""")
add("led_by_phase", lambda v: ledger.by_phase(v.ledger_events, "phase_2").select(*E_COLS), f"SELECT {', '.join(E_COLS)} FROM ledger_events WHERE upper(phase) = 'PHASE_2'")
add("led_by_type", lambda v: ledger.by_type(v.ledger_events, "FIX_APPLIED").select(*E_COLS), f"SELECT {', '.join(E_COLS)} FROM ledger_events WHERE event_type = 'FIX_APPLIED'")
add("led_audit", lambda v: ledger.audit(v.ledger_events), "SELECT run_id, sequence, timestamp, event_type, actor, phase, payload_ref FROM ledger_events")
add("led_causality", lambda v: ledger.causality(v.ledger_events), "SELECT run_id, payload_ref, sequence, event_type, count(*) OVER (PARTITION BY run_id, payload_ref) AS chain FROM ledger_events WHERE payload_ref IS NOT NULL")
add("led_seq_gaps", lambda v: ledger.sequence_gaps(v.ledger_events), GAPS)
add("led_nonint_seq", lambda v: ledger.noninteger_sequences(_raw(v)), """
SELECT run_id, n - 1 AS index, sequence_text FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY id) AS n, CASE WHEN id % 17 = 0 THEN 'x' || CAST(sequence AS VARCHAR) ELSE CAST(sequence AS VARCHAR) END AS sequence_text FROM ledger_events)
WHERE try_cast(sequence_text AS INT) IS NULL""")  # fmt: skip


def _raw(v: Views):
    """The events as raw records, of which every seventeenth has a broken sequence."""
    text = F.when(F.col("id") % 17 == 0, F.concat(F.lit("x"), F.col("sequence").cast("string"))).otherwise(F.col("sequence").cast("string"))
    from pyspark.sql import Window

    return v.ledger_events.select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("id")) - 1).alias("index"), text.alias("sequence_text"))


MISMATCH = f"SELECT l.run_id, l.sequence, l.event_type, r.final_state FROM ledger_events l JOIN ledger_runs r ON r.run_id = l.run_id WHERE l.event_type IN {TERMINAL} AND r.final_state <> '' AND NOT {AGREE}"
OPEN = f"SELECT run_id, event_type AS last_event FROM ({LAST}) WHERE event_type NOT IN {TERMINAL}"
add("led_terminal_mismatch", lambda v: ledger.terminal_mismatch(v.ledger_events, v.ledger_runs), MISMATCH)
add("led_no_terminal", lambda v: ledger.no_terminal(v.ledger_events), OPEN)
REPLAY = f"""
SELECT r.run_id, final_state, coalesce(event_count, 0) AS event_count, coalesce(issues, 0) AS issues_detected, coalesce(fixes, 0) AS fixes_count, coalesce(overrides, 0) AS overrides, coalesce(b.n, 0) AS violations,
  coalesce(approvals, 0) > 0 AS plan_approved, coalesce(safe, 0) > 0 AS safety_passed, coalesce(aborted, 0) > 0 AS aborted, coalesce(rejected, 0) > 0 AS rejected, edr_id, {SECONDS} AS duration_seconds FROM ledger_runs r
LEFT JOIN (SELECT run_id, count(*) AS event_count, count(*) FILTER (WHERE event_type = 'ISSUE_DETECTED') AS issues, count(*) FILTER (WHERE event_type = 'FIX_APPLIED') AS fixes, count(*) FILTER (WHERE event_type = 'PLAN_APPROVED') AS approvals,
  count(*) FILTER (WHERE event_type = 'SAFETY_CHECK_PASSED') AS safe, count(*) FILTER (WHERE event_type IN ('RUN_ABORTED', 'RUN_REJECTED')) AS overrides, count(*) FILTER (WHERE event_type = 'RUN_ABORTED') AS aborted, count(*) FILTER (WHERE event_type = 'RUN_REJECTED') AS rejected FROM ledger_events GROUP BY run_id) c ON c.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM (SELECT run_id FROM ({GAPS}) UNION ALL SELECT run_id FROM ({MISMATCH}) UNION ALL SELECT run_id FROM ({OPEN})) GROUP BY run_id) b ON b.run_id = r.run_id
LEFT JOIN ({REPORT}) e ON e.run_id = r.run_id"""


def _items(v: Views):
    """The replay's arrays as flat texts; an empty array is null."""
    flat = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[f].cast("string") for f in fields])), ";")
    t = ledger.replay_items(v.ledger_events)
    cols = {"approvals": flat("approvals", "sequence", "actor", "actor_role"), "fixes": flat("fixes", "sequence", "actor", "summary"), "overrides": flat("overrides", "sequence", "event_type", "summary"), "policy_refs": F.array_join("policy_refs", ";")}
    return t.select("run_id", *[F.nullif(c, F.lit("")).alias(n) for n, c in cols.items()])


add("led_replay", lambda v: ledger.replay(v.ledger_events, v.ledger_runs), REPLAY)
add("led_replay_fold", _items, """
SELECT run_id, string_agg(sequence || ' ' || actor || ' ' || actor_role, ';' ORDER BY sequence, id) FILTER (WHERE event_type = 'PLAN_APPROVED') AS approvals,
  string_agg(sequence || ' ' || coalesce(nullif(actor_role, ''), actor) || ' ' || summary, ';' ORDER BY sequence, id) FILTER (WHERE event_type = 'FIX_APPLIED') AS fixes,
  string_agg(sequence || ' ' || event_type || ' ' || summary, ';' ORDER BY sequence, id) FILTER (WHERE event_type IN ('RUN_ABORTED', 'RUN_REJECTED')) AS overrides,
  string_agg(DISTINCT payload_ref, ';' ORDER BY payload_ref) FILTER (WHERE event_type = 'SAFETY_CHECK_PASSED' AND payload_ref <> '') AS policy_refs FROM ledger_events GROUP BY run_id""")
add("led_replay_steps", _replayed_in_steps, REPLAY)
add("led_phase_counts", lambda v: ledger.phase_counts(v.ledger_events), "SELECT run_id, upper(phase) AS phase, count(*) AS events FROM ledger_events GROUP BY 1, 2")
add("led_type_hist", lambda v: ledger.type_counts(v.ledger_events), "SELECT run_id, event_type, count(*) AS events FROM ledger_events GROUP BY 1, 2")
add("led_first_last", lambda v: ledger.first_last(v.ledger_events), """SELECT run_id, min_by(event_type, (sequence, id)) AS first_event, min_by(timestamp, (sequence, id)) AS first_at,
  max_by(event_type, (sequence, id)) AS last_event, max_by(timestamp, (sequence, id)) AS last_at FROM ledger_events GROUP BY run_id""")
add("led_inspect", lambda v: files.report_json(ledger.inspect(v.ledger_events, v.ledger_runs), "run_id"))
add("led_contiguous", lambda v: ledger.contiguous(v.ledger_events), "SELECT run_id, min(sequence) = 0 AND max(sequence) = count(*) - 1 AND count(DISTINCT sequence) = count(*) AS contiguous FROM ledger_events GROUP BY run_id")
BEFORE = "SELECT run_id, coalesce(min(sequence) FILTER (WHERE event_type = '{}') < min(sequence) FILTER (WHERE event_type = 'FIX_APPLIED'), true) AS in_order FROM ledger_events GROUP BY run_id"
add("led_approval_before_fix", lambda v: ledger.ordered_before(v.ledger_events, "PLAN_APPROVED", "FIX_APPLIED"), BEFORE.format("PLAN_APPROVED"))
add("led_safety_before_fix", lambda v: ledger.ordered_before(v.ledger_events, "SAFETY_CHECK_PASSED", "FIX_APPLIED"), BEFORE.format("SAFETY_CHECK_PASSED"))
add("led_terminal_strict", lambda v: ledger.terminal_strict(v.ledger_events, v.ledger_runs), f"""SELECT l.run_id, coalesce(CASE l.event_type WHEN 'RUN_COMPLETED' THEN 'COMPLETE' WHEN 'RUN_ABORTED' THEN 'ABORTED' WHEN 'RUN_REJECTED' THEN 'REJECTED' END = r.final_state, false) AS matches
FROM ({LAST}) l JOIN ledger_runs r ON r.run_id = l.run_id""")
add("led_fix_breakdown", lambda v: ledger.fix_breakdown(v.ledger_events), "SELECT run_id, coalesce(payload_ref, 'unknown') AS rule, count(*) AS fixes FROM ledger_events WHERE event_type = 'FIX_APPLIED' GROUP BY 1, 2")
FIELDS = ("event_count", "fixes_count", "final_state")
add("led_replay_diff", lambda v: ledger.replay_diff(ledger.replay(v.ledger_events, v.ledger_runs), _recorded(v), FIELDS), f"""
WITH rep AS ({REPLAY}), rec AS (SELECT run_id, count(*) AS event_count, count(*) FILTER (WHERE event_type = 'FIX_APPLIED' AND phase <> 'PHASE_1') AS fixes_count, 'COMPLETE' AS final_state FROM ledger_events GROUP BY run_id),
b AS (SELECT coalesce(a.run_id, c.run_id) AS run_id, unnest(['event_count', 'fixes_count', 'final_state']) AS field, unnest([CAST(a.event_count AS VARCHAR), CAST(a.fixes_count AS VARCHAR), a.final_state]) AS replayed,
  unnest([CAST(c.event_count AS VARCHAR), CAST(c.fixes_count AS VARCHAR), c.final_state]) AS recorded FROM rep a FULL JOIN rec c ON a.run_id = c.run_id)
SELECT run_id, field, replayed, recorded FROM b WHERE replayed IS DISTINCT FROM recorded""")  # fmt: skip


def _recorded(v: Views):
    """A recorded summary that differs from the replay: it misses the fixes of one phase and takes every run for complete."""
    return v.ledger_events.groupBy("run_id").agg(F.count("*").alias("event_count"), F.count_if((F.col("event_type") == "FIX_APPLIED") & (F.col("phase") != "PHASE_1")).alias("fixes_count"), F.lit("COMPLETE").alias("final_state"))


add("led_seal", lambda v: ledger.seal(v.ledger_runs), "SELECT run_id, CASE final_state WHEN 'INCOMPLETE' THEN 'RUN_ABORTED' WHEN 'ABORTED' THEN 'RUN_ABORTED' WHEN 'REJECTED' THEN 'RUN_REJECTED' ELSE 'RUN_COMPLETED' END AS event_type FROM ledger_runs WHERE final_state IS NOT NULL")
FOUND = "SELECT run_id, id, 'Analyzer' || CAST(line_number % 5 AS VARCHAR) AS analyzer, severity || ' ' || issue_code AS summary, issue_code AS bug_class, severity, 50 + id % 50 AS confidence, issue_code || ' in ' || file_path AS problem_statement FROM analysis_results WHERE severity = 'critical'"


def _found(v: Views):
    r = v.analysis_results.where("severity = 'critical'")
    return r.select(
        "run_id", "id", F.concat(F.lit("Analyzer"), (F.col("line_number") % 5).cast("string")).alias("analyzer"), F.concat_ws(" ", "severity", "issue_code").alias("summary"), F.col("issue_code").alias("bug_class"), "severity",
        (50 + F.col("id") % 50).alias("confidence"), F.concat("issue_code", F.lit(" in "), "file_path").alias("problem_statement"),
    )


add("led_proposals", lambda v: ledger.proposals(ledger.finding_events(_found(v))), f"SELECT run_id, CAST(id AS VARCHAR) AS id, bug_class, severity, CAST(confidence AS DOUBLE) / 100 AS confidence, problem_statement FROM ({FOUND})")
add("led_from_findings", lambda v: ledger.from_findings(_found(v)), f"""
WITH f AS ({FOUND}), n AS (SELECT run_id, count(*) AS n FROM f GROUP BY run_id)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY id) AS sequence, 'INTELLIGENCE_PROPOSAL' AS event_type, lower(analyzer) AS actor, CAST(id AS VARCHAR) AS payload_ref, substr(summary, 1, 1000) AS summary FROM f
UNION ALL SELECT run_id, 0, 'INTELLIGENCE_STARTED', 'orchestrator', NULL, 'analysis started' FROM n
UNION ALL SELECT run_id, n + 1, 'INTELLIGENCE_COMPLETED', 'orchestrator', NULL, CAST(n AS VARCHAR) || ' findings' FROM n""")
#: What is read of the payload of a whole finding, in one pass over it.
WHOLE = """bug_class string, severity string, confidence double, problem_statement string, affected_files array<string>, suggested_strategies array<struct<description: string>>, constraints struct<no_execution: boolean>,
metadata struct<risk_explanation: string, decision_required_for: string>, full_proposal struct<affected_files: array<struct<line_range: string>>>"""


def _whole(v: Views):
    """What the payloads of whole findings hold, read back from their JSON, each once."""
    from .finding_queries import full

    events = ledger.finding_events(full(v).withColumn("run_id", F.col("repo_id")))
    p = events.select(F.col("payload_ref").cast("long").alias("id"), "run_id", "event_type", F.from_json("payload", WHOLE).alias("p"))
    return p.select(
        "id", "run_id", "event_type", "p.bug_class", "p.severity", "p.confidence", F.col("p.problem_statement").alias("summary"),
        F.array_join("p.affected_files", ",").alias("files"), F.size("p.suggested_strategies").alias("strategies"), F.get("p.suggested_strategies", F.lit(0))["description"].alias("first_way"),
        F.col("p.constraints.no_execution").cast("string").alias("no_execution"), "p.metadata.risk_explanation", F.col("p.metadata.decision_required_for").alias("decision"), F.get("p.full_proposal.affected_files", F.lit(0))["line_range"].alias("line_range"),
    )


def _whole_sql() -> str:
    from .finding_queries import FINDP

    return f"""SELECT id, repo_id AS run_id, 'INTELLIGENCE_PROPOSAL' AS event_type, bug_class, severity, confidence / 100 AS confidence, problem_statement AS summary, CASE WHEN id % 13 = 0 THEN '' ELSE array_to_string(paths, ',') END AS files, CASE WHEN id % 17 = 0 THEN 0 ELSE n_strategies END AS strategies,
  CASE WHEN id % 17 <> 0 THEN 'Do step 1' END AS first_way, 'true' AS no_execution, CASE WHEN id % 7 <> 0 THEN 'It may fail: ' || problem_statement END AS risk_explanation, CASE WHEN id % 10 = 0 THEN 'the design' END AS decision, CASE WHEN id % 13 <> 0 THEN line_range END AS line_range FROM ({FINDP})"""


add("led_finding_event_full", _whole, _whole_sql())
add("led_selection_event", lambda v: ledger.selection_events(v.analysis_results.select(F.col("category").alias("plan"), F.col("issue_code").alias("analyzer_id"))), """
SELECT category AS plan, 'selection:' || category || ':' || string_agg(DISTINCT issue_code, ',' ORDER BY issue_code) AS payload_ref FROM analysis_results GROUP BY category""")
add("led_runs_list", lambda v: ledger.runs_list(v.ledger_runs), """
SELECT run_id, r.repo_id, started_at, final_state, run_id = latest AS is_latest FROM ledger_runs r JOIN (SELECT repo_id, max_by(run_id, (started_at, run_id)) AS latest FROM ledger_runs GROUP BY repo_id) l ON l.repo_id = r.repo_id""")
