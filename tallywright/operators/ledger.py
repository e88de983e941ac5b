"""Queries, replay and invariants over append-only run logs.

Events have run_id, sequence, id, timestamp, event_type, actor, actor_role, phase, payload_ref, summary; run headers have
run_id, repo_id, run_policy_id, started_at, ended_at, final_state. Events are ordered by sequence, then id, never by time.
Every operator takes all runs at once and works per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest stored summary, in characters.
SUMMARY = 1000
#: What each terminal event agrees with. Fixed values.
TERMINAL_STATES = {"RUN_COMPLETED": ("COMPLETE", "COMPLETED"), "RUN_ABORTED": ("ABORTED", "INCOMPLETE"), "RUN_REJECTED": ("REJECTED",)}
SEAL_EVENTS = {"COMPLETE": "RUN_COMPLETED", "INCOMPLETE": "RUN_ABORTED", "ABORTED": "RUN_ABORTED", "REJECTED": "RUN_REJECTED"}
ORDER = ("sequence", "id")


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def _last(events: DataFrame, *cols: str) -> DataFrame:
    """The given columns of the last event of each run; a struct keeps nulls."""
    top = events.groupBy("run_id").agg(F.max_by(F.struct(*cols), F.struct(*ORDER)).alias("last"))
    return top.select("run_id", *[F.col(f"last.{c}").alias(c) for c in cols])


def seconds(start: Column, end: Column) -> Column:
    """end - start in seconds; null if either is null."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def timeline(events: DataFrame) -> DataFrame:
    """All events in the order of their run."""
    return events.orderBy("run_id", *ORDER)


def durations(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", seconds(F.col("started_at"), F.col("ended_at")).alias("duration_seconds"))


def human_approvals(events: DataFrame) -> DataFrame:
    """Approvals whose role is human, whatever its case."""
    return events.groupBy("run_id").agg(F.count_if(_is("PLAN_APPROVED") & (F.lower("actor_role") == "human")).alias("human_approvals"))


def policies(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, policy): the header's policy unless LEGACY in any case, and the references of safety passes and policy events;
    distinct, without empty ones."""
    own = runs.where(F.upper("run_policy_id") != "LEGACY").select("run_id", F.col("run_policy_id").alias("policy"))
    seen = events.where(_is("SAFETY_CHECK_PASSED") | F.col("event_type").contains("POLICY"))
    return own.union(seen.select("run_id", "payload_ref")).where("policy <> ''").distinct()


def policy_lists(events: DataFrame, runs: DataFrame) -> DataFrame:
    return policies(events, runs).groupBy("run_id").agg(F.array_sort(F.collect_set("policy")).alias("policies"))


def last_report(events: DataFrame) -> DataFrame:
    """The reference of each run's last finalized report, even if it is null."""
    return _last(events.where(_is("EDR_FINALIZED")), "payload_ref").withColumnRenamed("payload_ref", "edr_id")


def summary(events: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each run header: start, end, duration, state, counts of events, fixes and human approvals, policies, report."""
    counts = events.groupBy("run_id").agg(
        F.count("*").alias("event_count"), F.count_if(_is("FIX_APPLIED")).alias("fixes_count"), F.count_if(_is("PLAN_APPROVED") & (F.lower("actor_role") == "human")).alias("human_approvals")
    )
    listed = policy_lists(events, runs).select("run_id", F.array_join("policies", ",").alias("policies"))
    out = runs.join(counts, "run_id", "left").join(listed, "run_id", "left").join(last_report(events), "run_id", "left")
    return out.select(
        "run_id", "started_at", "ended_at", seconds(F.col("started_at"), F.col("ended_at")).alias("duration_seconds"), "final_state",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("event_count", "fixes_count", "human_approvals")], F.coalesce("policies", F.lit("")).alias("policies"), "edr_id",
    )


def by_phase(events: DataFrame, phase: str) -> DataFrame:
    return events.where(F.upper("phase") == phase.upper())


def by_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(_is(event_type))


def audit(events: DataFrame) -> DataFrame:
    return events.orderBy("run_id", *ORDER).select("run_id", "sequence", "timestamp", "event_type", "actor", "phase", "payload_ref")


def causality(events: DataFrame) -> DataFrame:
    """(run_id, payload_ref, sequence, event_type, chain): events of a run that share a reference, with the number of them."""
    refs = events.where(F.col("payload_ref").isNotNull())
    return refs.select("run_id", "payload_ref", "sequence", "event_type", F.count("*").over(Window.partitionBy("run_id", "payload_ref")).alias("chain"))


def sequence_gaps(events: DataFrame) -> DataFrame:
    """(run_id, expected, found): the first sequence must be 0 and each next one more than the last; what follows a gap is held against it."""
    w = Window.partitionBy("run_id").orderBy(*ORDER)
    expected = F.lag("sequence", 1, -1).over(w) + 1
    return events.select("run_id", expected.alias("expected"), F.col("sequence").alias("found")).where("expected <> found")


def noninteger_sequences(raw: DataFrame) -> DataFrame:
    """(run_id, index, sequence_text): records whose sequence is not an integer, by their place (from 0) in the file."""
    return raw.where(F.col("sequence_text").try_cast("int").isNull()).select("run_id", "index", "sequence_text")


def _agrees(event: Column | None = None) -> Column:
    """Whether a terminal event agrees with final_state."""
    event = F.col("event_type") if event is None else event
    out = F.lit(False)
    for name, states in TERMINAL_STATES.items():
        out = out | ((event == name) & F.col("final_state").isin(*states))
    return out


def _terminal(events: DataFrame, runs: DataFrame) -> DataFrame:
    return _last(events, "event_type").join(runs.select("run_id", "final_state"), "run_id")


def terminal_mismatch(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, sequence, event_type, final_state): every terminal event that disagrees with its header's state, where that is set."""
    ends = events.where(F.col("event_type").isin(*TERMINAL_STATES)).join(runs.select("run_id", "final_state"), "run_id")
    return ends.where((F.col("final_state") != "") & ~_agrees()).select("run_id", "sequence", "event_type", "final_state")


def no_terminal(events: DataFrame) -> DataFrame:
    """Runs whose last event is not terminal; runs without events are tolerated."""
    return _last(events, "event_type").where(~F.col("event_type").isin(*TERMINAL_STATES)).select("run_id", F.col("event_type").alias("last_event"))


def violations(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, violation) of the replay's invariants."""
    gaps = sequence_gaps(events).select("run_id", F.concat(F.lit("sequence-gap-or-out-of-order: expected "), F.col("expected").cast("string"), F.lit(", found "), F.col("found").cast("string")).alias("violation"))
    wrong = terminal_mismatch(events, runs).select("run_id", F.concat(F.lit("terminal-mismatch: ledger="), "final_state", F.lit(" event="), "event_type"))
    open_ = no_terminal(events).select("run_id", F.lit("no-terminal-event"))
    return gaps.union(wrong).union(open_)


#: The state that a replay folds a run's events to; two of them, one after the other, merge.
REPLAY_STATE = (
    "run_id string, event_count long, issues_detected long, approvals long, safety_passes long, fixes_count long, completed long, aborted long, rejected long, gaps long, "
    "first_sequence long, last_sequence long, last_event string, reports long, edr_id string"
)
_COUNTS = {"issues_detected": "ISSUE_DETECTED", "approvals": "PLAN_APPROVED", "safety_passes": "SAFETY_CHECK_PASSED", "fixes_count": "FIX_APPLIED", "completed": "RUN_COMPLETED", "aborted": "RUN_ABORTED", "rejected": "RUN_REJECTED", "reports": "EDR_FINALIZED"}


def fold(events: DataFrame) -> DataFrame:
    """REPLAY_STATE of each run's events, in one pass; gaps are those between two of these events."""
    before = F.lag("sequence").over(Window.partitionBy("run_id").orderBy(*ORDER))
    at = F.struct(*ORDER)
    t = events.select("run_id", "sequence", "id", "event_type", "payload_ref", (F.col("sequence") != before + 1).alias("gap"))
    out = t.groupBy("run_id").agg(
        F.count("*").alias("event_count"), *[F.count_if(_is(e)).alias(c) for c, e in _COUNTS.items()], F.count_if("gap").alias("gaps"), F.min("sequence").cast("long").alias("first_sequence"), F.max("sequence").cast("long").alias("last_sequence"),
        F.max_by("event_type", at).alias("last_event"), F.max_by(F.struct("payload_ref"), F.when(_is("EDR_FINALIZED"), at)).alias("report"),
    )
    return out.withColumn("edr_id", F.col("report.payload_ref")).select(*[x.split(" ")[0] for x in REPLAY_STATE.split(", ")])


def fold_onto() -> dict[str, Column]:
    """How a state `o` goes on with the state `n` of later events, either of which may be absent: for KeyedTable.merge."""
    plus = lambda c: F.coalesce(f"o.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0))
    seam = F.coalesce((F.col("n.first_sequence") != F.col("o.last_sequence") + 1).cast("long"), F.lit(0))
    return {c: plus(c) for c in ("event_count", *_COUNTS)} | {"gaps": plus("gaps") + seam, "first_sequence": F.coalesce("o.first_sequence", "n.first_sequence"), "edr_id": F.when(F.col("n.reports") > 0, F.col("n.edr_id")).otherwise(F.col("o.edr_id"))}


def replayed(states: DataFrame, runs: DataFrame) -> DataFrame:
    """Flat replay state, one row for each run header, of folded states. A first sequence that is not 0 is a gap too."""
    t = runs.select("run_id", "final_state", "started_at", "ended_at").join(states, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    wrong = sum((F.when((F.col("final_state") != "") & ~_agrees(F.lit(e)), zero(c)).otherwise(F.lit(0)) for c, e in (("completed", "RUN_COMPLETED"), ("aborted", "RUN_ABORTED"), ("rejected", "RUN_REJECTED"))), F.lit(0))
    open_ = zero((~F.col("last_event").isin(*TERMINAL_STATES)).cast("long"))
    broken = zero("gaps") + zero((F.col("first_sequence") != 0).cast("long")) + wrong + open_
    return t.select(
        "run_id", "final_state", *[zero(c).alias(c) for c in ("event_count", "issues_detected", "fixes_count")], (zero("aborted") + zero("rejected")).alias("overrides"), broken.alias("violations"),
        *[(zero(c) > 0).alias(n) for c, n in (("approvals", "plan_approved"), ("safety_passes", "safety_passed"), ("aborted", "aborted"), ("rejected", "rejected"))], "edr_id",
        seconds(F.col("started_at"), F.col("ended_at")).alias("duration_seconds"),
    )


def replay(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Flat replay state, one row for each run header."""
    return replayed(fold(events), runs)


def replay_items(events: DataFrame) -> DataFrame:
    """(run_id, approvals, fixes, overrides, policy_refs): approvals as (sequence, id, actor, actor_role, timestamp), fixes as
    (sequence, id, actor, summary), the actor being the role, else the actor; aborted and rejected events as (sequence, id,
    event_type, summary), all in order; and the sorted references of safety passes."""
    role = F.when(F.col("actor_role") != "", F.col("actor_role")).otherwise(F.col("actor"))
    listed = lambda cond, *cols: F.sort_array(F.collect_list(F.when(cond, F.struct("sequence", "id", *cols))))
    passed = F.when(_is("SAFETY_CHECK_PASSED") & (F.col("payload_ref") != ""), F.col("payload_ref"))
    return events.groupBy("run_id").agg(
        listed(_is("PLAN_APPROVED"), "actor", "actor_role", "timestamp").alias("approvals"), listed(_is("FIX_APPLIED"), role.alias("actor"), "summary").alias("fixes"),
        listed(F.col("event_type").isin("RUN_ABORTED", "RUN_REJECTED"), "event_type", "summary").alias("overrides"), F.array_sort(F.collect_set(passed)).alias("policy_refs"),
    )


def replay_nested(events: DataFrame, runs: DataFrame) -> DataFrame:
    """The whole replay state of a run in one row: arrays, phase map and violations."""
    phases = phase_counts(events).groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", "events")))).alias("phases"))
    broken = violations(events, runs).groupBy("run_id").agg(F.array_sort(F.collect_list("violation")).alias("violation_texts"))
    return replay(events, runs).join(replay_items(events), "run_id", "left").join(phases, "run_id", "left").join(broken, "run_id", "left")


def phase_counts(events: DataFrame, upper: bool = True) -> DataFrame:
    """Events of each run and phase; phases in upper case, or as they are."""
    return events.groupBy("run_id", (F.upper("phase") if upper else F.col("phase")).alias("phase")).agg(F.count("*").alias("events"))


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "event_type").agg(F.count("*").alias("events"))


def first_last(events: DataFrame) -> DataFrame:
    at = F.struct(*ORDER)
    return events.groupBy("run_id").agg(
        F.min_by("event_type", at).alias("first_event"), F.min_by("timestamp", at).alias("first_at"), F.max_by("event_type", at).alias("last_event"), F.max_by("timestamp", at).alias("last_at")
    )


def inspect(events: DataFrame, runs: DataFrame, audit_rows: int = 50) -> DataFrame:
    """The inspection report of each run in one row; of the audit trail the first `audit_rows` events, as the report shows no more."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(*ORDER))
    trail = events.withColumn("rank", rank).where(F.col("rank") <= audit_rows).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "id", "event_type", "actor", "phase"))).alias("audit"))
    types = type_counts(events).groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "events")))).alias("event_types"))
    phases = phase_counts(events, upper=False).groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", "events")))).alias("phases"))
    return summary(events, runs).join(first_last(events), "run_id", "left").join(types, "run_id", "left").join(phases, "run_id", "left").join(trail, "run_id", "left")


def contiguous(events: DataFrame) -> DataFrame:
    """Whether the sorted sequences equal 0 to n - 1."""
    n = F.count("*")
    return events.groupBy("run_id").agg(((F.min("sequence") == 0) & (F.max("sequence") == n - 1) & (F.count_distinct("sequence") == n)).alias("contiguous"))


def ordered_before(events: DataFrame, first: str, then: str) -> DataFrame:
    """Whether the first event of one type comes before the first of another; true where either is absent."""
    a, b = F.min(F.when(_is(first), F.col("sequence"))), F.min(F.when(_is(then), F.col("sequence")))
    return events.groupBy("run_id").agg(F.coalesce(a < b, F.lit(True)).alias("in_order"))


def terminal_strict(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether the last event maps to exactly the header's state; INCOMPLETE never does."""
    state = F.when(_is("RUN_COMPLETED"), "COMPLETE").when(_is("RUN_ABORTED"), "ABORTED").when(_is("RUN_REJECTED"), "REJECTED")
    return _terminal(events, runs).select("run_id", F.coalesce(state == F.col("final_state"), F.lit(False)).alias("matches"))


def fix_breakdown(events: DataFrame) -> DataFrame:
    """Fixes of each run by the rule in their reference: the "rule" of a JSON payload, else the reference itself."""
    rule = F.coalesce(F.get_json_object("payload_ref", "$.rule"), F.col("payload_ref"), F.lit("unknown"))
    return events.where(_is("FIX_APPLIED")).groupBy("run_id", rule.alias("rule")).agg(F.count("*").alias("fixes"))


def replay_diff(replayed: DataFrame, recorded: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(run_id, field, replayed, recorded): fields in which the two disagree, null-safe; runs that one side lacks differ in every non-null field."""
    text = lambda side: F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f"{side}.{f}").cast("string") for f in fields]))
    both = replayed.alias("a").join(recorded.alias("b"), F.col("a.run_id") == F.col("b.run_id"), "full_outer")
    both = both.select(F.coalesce("a.run_id", "b.run_id").alias("run_id"), text("a").alias("x"), text("b").alias("y"))
    rows = both.select("run_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"), "x", "y")
    out = rows.select("run_id", "field", F.col("x")[F.col("field")].alias("replayed"), F.col("y")[F.col("field")].alias("recorded"))
    return out.where(~F.col("replayed").eqNullSafe(F.col("recorded")))


def seal(runs: DataFrame) -> DataFrame:
    """(run_id, event_type): the terminal event of each header with a state; RUN_COMPLETED for states that are not listed."""
    event = F.lit("RUN_COMPLETED")
    for state, name in SEAL_EVENTS.items():
        event = F.when(F.col("final_state") == state, name).otherwise(event)
    return runs.where(F.col("final_state").isNotNull()).select("run_id", event.alias("event_type"))


def append(events: DataFrame, runs: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows that are appended of incoming (run_id, id, event_type, summary): those of runs that are not sealed, with the
    next dense sequence of their run and the summary cut to SUMMARY characters."""
    sealed = runs.where(F.col("ended_at").isNotNull()).select("run_id")
    last = events.groupBy("run_id").agg(F.max("sequence").alias("last"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("id"))
    fresh = incoming.join(sealed, "run_id", "left_anti").withColumn("rank", rank).join(last, "run_id", "left")
    return fresh.select("run_id", "id", (F.coalesce("last", F.lit(-1)) + F.col("rank")).alias("sequence"), "event_type", F.substring("summary", 1, SUMMARY).alias("summary"))


def from_findings(findings: DataFrame) -> DataFrame:
    """Events of findings (run_id, id, analyzer, summary): a start, one for each finding in order of id, and a completion."""
    each = findings.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("id")).alias("sequence"), F.lit("INTELLIGENCE_PROPOSAL").alias("event_type"), F.lower("analyzer").alias("actor"), F.col("id").cast("string").alias("payload_ref"), F.substring("summary", 1, SUMMARY).alias("summary"))
    sizes = findings.groupBy("run_id").agg(F.count("*").cast("int").alias("n"))
    frame = lambda at, name, text: sizes.select("run_id", at.alias("sequence"), F.lit(name).alias("event_type"), F.lit("orchestrator").alias("actor"), F.lit(None).cast("string").alias("payload_ref"), text.alias("summary"))
    start = frame(F.lit(0), "INTELLIGENCE_STARTED", F.lit("analysis started"))
    end = frame(F.col("n") + 1, "INTELLIGENCE_COMPLETED", F.concat(F.col("n").cast("string"), F.lit(" findings")))
    return start.unionByName(each).unionByName(end)


#: What an event of a finding promises. Fixed values.
CONSTRAINTS = ("proposal_only", "no_execution", "human_approval_required")
_PARTS = ("id", "bug_class", "severity", "confidence", "problem_statement", "affected_files", "suggested_strategies")


def finding_events(findings: DataFrame) -> DataFrame:
    """Each finding (run_id, id, bug_class, severity, confidence, problem_statement and any others) as one event whose payload is JSON:
    confidence as a share, the summary, the paths of the files, the strategies whole, the constraints, every other column under
    metadata, and the finding as it is under full_proposal."""
    others = [c for c in findings.columns if c not in (*_PARTS, "run_id", "analyzer")]
    has = lambda c: c in findings.columns
    parts = [
        F.col("analyzer") if has("analyzer") else F.lit(None).cast("string").alias("analyzer"), F.col("id").cast("string").alias("id"), "bug_class", "severity", (F.col("confidence") / 100).alias("confidence"), "problem_statement",
        F.transform("affected_files", lambda f: f["path"]).alias("affected_files") if has("affected_files") else F.array().cast("array<string>").alias("affected_files"), *(["suggested_strategies"] if has("suggested_strategies") else []),
        F.struct(*[F.lit(True).alias(c) for c in CONSTRAINTS]).alias("constraints"), *([F.struct(*others).alias("metadata")] if others else []), F.struct(*[c for c in findings.columns if c != "run_id"]).alias("full_proposal"),
    ]
    return findings.select("run_id", F.lit("INTELLIGENCE_PROPOSAL").alias("event_type"), F.col("id").cast("string").alias("payload_ref"), F.to_json(F.struct(*parts)).alias("payload"))


def selection_events(selected: DataFrame) -> DataFrame:
    """(plan, payload_ref): one event for each plan of (plan, analyzer_id), with the sorted ids."""
    ids = F.array_join(F.array_sort(F.collect_set("analyzer_id")), ",")
    return selected.groupBy("plan").agg(F.concat(F.lit("selection:"), F.col("plan"), F.lit(":"), ids).alias("payload_ref"))


def runs_list(runs: DataFrame) -> DataFrame:
    """Every header, and whether it is the latest by start time (ties: largest run_id) of its repository."""
    latest = runs.groupBy("repo_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("latest"))
    return runs.join(latest, "repo_id").select("run_id", "repo_id", "started_at", "final_state", (F.col("run_id") == F.col("latest")).alias("is_latest"))


def proposals(events: DataFrame) -> DataFrame:
    """The parsed payloads of proposal events; those that do not parse are left out."""
    parsed = F.from_json("payload", "id string, bug_class string, severity string, confidence double, problem_statement string")
    return events.where(_is("INTELLIGENCE_PROPOSAL")).select("run_id", parsed.alias("p")).where("p.id IS NOT NULL").select("run_id", "p.*")
