"""Stream operators over run logs, webhooks and calls. Each takes a streaming or, where state allows, a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.stores import KeyedTable

TERMINAL = ("RUN_COMPLETED", "RUN_ABORTED", "RUN_REJECTED")
DECISION = "key string, at double, id long, allowed boolean, remaining long"
_DECIDED = ["key", "at", "id", "allowed", "remaining"]
BREACH = "run_id string, sequence int, kind string"


def ledger_tail(events: DataFrame) -> DataFrame:
    """Running summary of each run: events, fixes, last sequence and its event type. As a stream it keeps every run; ledger_tail_live
    lets ended ones go."""
    last = F.max(F.struct("sequence", "id", "event_type"))
    out = events.groupBy("run_id").agg(F.count("*").alias("event_count"), F.count_if(F.col("event_type") == "FIX_APPLIED").alias("fixes_count"), last.alias("last"))
    return out.select("run_id", "event_count", "fixes_count", F.col("last.sequence").alias("last_sequence"), F.col("last.event_type").alias("last_event"))


TAIL = "run_id string, event_count long, fixes_count long, last_sequence int, last_event string"


def ledger_tail_live(events: DataFrame, at: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """(run_id, event_count, fixes_count, last_sequence, last_event) of the runs that a micro-batch has events of, in update mode: for a sink
    by key, as merge_into. Once a run has ended and the watermark, `late` behind the latest time, has passed its last event,
    its state is dropped; events that come later still are dropped, as the watermark drops them."""

    ends = frozenset(TERMINAL)

    def tail(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, fixes, seq, number, last, ended, latest = state.get if state.exists else (0, 0, -1, -1, "", False, 0)
        for b in batches:
            kinds = b["event_type"].tolist()  # lists: a run has few events in a batch, and each step over a pandas column costs more than they do
            count, fixes = count + len(kinds), fixes + kinds.count("FIX_APPLIED")
            top = max(zip(b["sequence"].tolist(), b["id"].tolist(), kinds, strict=True))
            seq, number, last = max((seq, number, last), (int(top[0]), int(top[1]), top[2]))
            ended, latest = ended or not ends.isdisjoint(kinds), max(latest, int(max(b["us"].tolist())))
        state.update((count, fixes, seq, number, last, ended, latest))
        if ended:
            state.setTimeoutTimestamp(max(latest // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([(key[0], count, fixes, seq, last)], columns=["run_id", "event_count", "fixes_count", "last_sequence", "last_event"])

    own = events.withWatermark(at, late).select("run_id", "sequence", "id", "event_type", at, F.unix_micros(at).alias("us"))
    return own.groupBy("run_id").applyInPandasWithState(tail, TAIL, "count long, fixes long, seq int, number long, last string, ended boolean, latest long", "update", GroupStateTimeout.EventTimeTimeout)


def merge_into(table: KeyedTable, sets: dict[str, Column] | None = None, rows: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows of a micro-batch, one for each key, are merged into a stored table as the version of that batch; a batch
    that is run again replaces its own, so that sums count it once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch_id, rows(batch), sets)

    return run


def dedup_deliveries(deliveries: DataFrame, at: str = "received_at", late: str = "1 day") -> DataFrame:
    """The first row of each delivery_id; its state is dropped when the watermark is `late` past it."""
    return deliveries.withWatermark(at, late).dropDuplicatesWithinWatermark(["delivery_id"])


def trigger_runs(hooks: DataFrame, repositories: DataFrame) -> DataFrame:
    """(delivery_id, repo_full_name, status, reason): a pending run for each hook of a tracked, enabled repository; a stream joined to a table."""
    known = repositories.select("repo_full_name", F.col("is_enabled").alias("enabled"))
    status = (
        F.when((F.col("event") == "pull_request") & ~F.coalesce(F.col("action").isin("opened", "synchronize", "reopened"), F.lit(False)), "ignored")
        .when(F.col("sha").isNull() | F.col("repo_full_name").isNull(), "skipped").when(F.col("enabled"), "queued").otherwise("skipped")
    )
    reason = F.when(status == "ignored", "Action not configured").when(F.col("sha").isNull() | F.col("repo_full_name").isNull(), "Missing required fields").when(status == "skipped", "Repository not tracked or disabled")
    return hooks.join(known, "repo_full_name", "left").select("delivery_id", "repo_full_name", status.alias("status"), reason.alias("reason"))


def _decide(times: list[float], at: float, limit: int, window: float) -> tuple[list[float], bool, int]:
    """Times of allowed calls after a call at `at`, whether it is allowed, and the calls left or the seconds to wait."""
    times = [t for t in times if at - t < window]
    if len(times) >= limit:
        return times, False, int(window - (at - times[0]))
    return [*times, at], True, limit - len(times) - 1


def rate_limit(calls: DataFrame, limit: int = 10, window: float = 3600.0) -> DataFrame:
    """Decisions on a table of calls (key, at in seconds, id), in order of (at, id) for each key. A decision depends on the ones
    before it, so that a key's calls pass one task, in sorted batches; no more than `limit` times are held."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, []
        for batch in batches:
            out = []
            for k, at, i in zip(batch["key"], batch["at"], batch["id"], strict=True):
                if k != key:
                    key, times = k, []
                times, ok, left = _decide(times, at, limit, window)
                out.append((k, at, i, ok, left))
            yield pd.DataFrame(out, columns=["key", "at", "id", "allowed", "remaining"])

    rows = calls.select(F.coalesce("key", F.lit("")).alias("key"), F.col("at").cast("double").alias("at"), F.col("id").cast("long").alias("id")).where("at IS NOT NULL")
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(decide, DECISION)


def _timeout(idle: float | None) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def rate_limit_stream(calls: DataFrame, limit: int = 10, window: float = 3600.0, idle: float | None = None) -> DataFrame:
    """The same over a stream, in order within each micro-batch; the state of a key is its allowed times. With `idle`, it is dropped
    when no call has come for so many seconds of the clock, or for the window if that is longer; such a stream looks for
    idle keys for ever, so it needs a trigger by time, not availableNow."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, out = list(state.get[0]) if state.exists else [], []
        for at, i in sorted((at, i) for b in batches for at, i in zip(b["at"], b["id"], strict=True)):
            times, ok, left = _decide(times, at, limit, window)
            out.append((key[0], at, i, ok, left))
        state.update((times,))
        if idle is not None:
            state.setTimeoutDuration(int(1000 * max(window, idle)))
        yield pd.DataFrame(out, columns=["key", "at", "id", "allowed", "remaining"])

    return calls.select("key", "at", "id").groupBy("key").applyInPandasWithState(decide, DECISION, "times array<double>", "append", _timeout(idle))


def _limiter(limit: int, window: float):
    """The processor of rate_limit_live. Whenever calls of a key wait, a timer stands at the earliest of them or before: one for each key and
    micro-batch, and one for what still waits after it."""
    from pyspark.sql.streaming import StatefulProcessor

    class Limiter(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at double, id long")
            self.times = handle.getListState("times", "at double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            first = None
            for pdf in rows:
                new = list(zip(pdf["at"].tolist(), pdf["id"].tolist(), strict=True))
                if new:
                    self.waiting.appendList(new)
                    least = min(new)[0]
                    first = least if first is None else min(first, least)
            if first is not None:
                self.handle.registerTimer(int(first * 1000) + 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            sure = timerValues.getCurrentWatermarkInMs() / 1000
            waiting, times, out = sorted(tuple(w) for w in self.waiting.get()), [t[0] for t in self.times.get()], []
            rest = [w for w in waiting if w[0] >= sure]
            for at, i in waiting[: len(waiting) - len(rest)]:
                times, ok, left = _decide(times, at, limit, window)
                out.append((key[0], at, i, ok, left))
            times = [t for t in times if sure - t < window]
            for state, values in ((self.waiting, rest), (self.times, [(t,) for t in times])):
                if values:
                    state.put(values)
                else:
                    state.clear()
            if rest:
                self.handle.registerTimer(int(rest[0][0] * 1000) + 1)
            elif times:
                self.handle.registerTimer(int((max(times) + window) * 1000) + 1)
            return iter([pd.DataFrame(out, columns=_DECIDED)] if out else ())

        def close(self) -> None:
            pass

    return Limiter()


def rate_limit_live(calls: DataFrame, limit: int = 10, window: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """The decisions of rate_limit over a stream whose calls may come late, within `late`: a call waits in its key's list state until the
    watermark has passed it, as nothing older can come then, and timers of event time decide the waiting ones in order. A key's state is
    its waiting calls and the times of allowed ones that still count; it goes when a later timer finds neither. Needs the RocksDB state
    store (see rocksdb)."""
    own = calls.select(F.coalesce("key", F.lit("")).alias("key"), F.col("at").cast("double").alias("at"), F.col("id").cast("long").alias("id"), F.timestamp_micros(F.floor(F.col("at") * 1e6)).alias("ts")).where("at IS NOT NULL")
    return own.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_limiter(limit, window), DECISION, "Append", "eventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def daily_counts(runs: DataFrame, at: str = "created_at", late: str = "1 day") -> DataFrame:
    """(day, total, completed, failed) in tumbling windows of a day."""
    out = runs.withWatermark(at, late).groupBy(F.window(at, "1 day")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.select(F.to_date("window.start").alias("day"), "total", "completed", "failed")


def watch_invariants(events: DataFrame, at: str = "timestamp", late: str = "1 hour", forget: float | None = None) -> DataFrame:
    """(run_id, sequence, kind): gap (not the next sequence), after_end (beyond a terminal event), early_fix (before any approval), as
    the batch form over all events finds them, in whatever order they arrive within `late`.

    Events of a run that are not the next one wait in its state. They go on when those before them have come, or when the watermark
    (`late` behind the latest time) has passed them, since nothing older can come then: only that is a gap. Older events are
    dropped, as the watermark drops them. With `forget`, the state of a run that has ended is dropped when the watermark is so many
    seconds past its last event; a later event still would look like a new run's."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, approved, sealed, latest, seqs, ids, kinds, times = state.get if state.exists else (-1, False, False, 0, [], [], [], [])
        waiting = sorted([*zip(seqs, ids, kinds, times, strict=True), *((int(q), int(i), k, int(u)) for b in (() if state.hasTimedOut else batches) for q, i, k, u in zip(b["sequence"], b["id"], b["event_type"], b["us"], strict=True))])
        passed, out, n = state.getCurrentWatermarkMs() * 1000, [], 0
        sure = max((i + 1 for i, w in enumerate(waiting) if w[3] < passed), default=0)  # what stands before an event that the watermark has passed is older
        for seq, _, kind, us in waiting:
            if seq > last + 1 and n >= sure:
                break
            if seq != last + 1:
                out.append((key[0], seq, "gap"))
            if sealed:
                out.append((key[0], seq, "after_end"))
            if kind == "FIX_APPLIED" and not approved:
                out.append((key[0], seq, "early_fix"))
            last, approved, sealed, latest, n = seq, approved or kind == "PLAN_APPROVED", sealed or kind in TERMINAL, max(latest, us), n + 1
        rest = waiting[n:]
        over = latest + int(forget * 1e6) if sealed and forget is not None else None
        if not rest and state.hasTimedOut and over is not None and over < passed:
            state.remove()
        else:
            state.update((last, approved, sealed, latest, *([w[i] for w in rest] for i in range(4))))
            wake = min((w[3] for w in rest), default=over)
            if wake is not None:
                state.setTimeoutTimestamp(max(wake // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["run_id", "sequence", "kind"])

    own = events.withWatermark(at, late).select("run_id", "sequence", "id", "event_type", at, F.unix_micros(at).alias("us"))
    schema = "last int, approved boolean, sealed boolean, latest long, seqs array<int>, ids array<long>, kinds array<string>, times array<long>"
    return own.groupBy("run_id").applyInPandasWithState(watch, BREACH, schema, "append", GroupStateTimeout.EventTimeTimeout)


def refresh_metrics(metrics: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: metrics of the keys in a micro-batch are computed anew and appended as the snapshots of that batch; a batch
    that is run again replaces its own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        metrics(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs a stream over all that has arrived. Complete results replace those of earlier batches; others are kept batch by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(sink or write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
