"""Stream operators on small inputs; decisions against a brute-force version, and state that lasts over micro-batches."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from tallywright.plans import catalog
from tallywright.sources import stores
from tallywright.streaming import streams

SF = "/root/testdata/sf0.001"


def brute(calls, limit, window):
    allowed, out = {}, []
    for key, at, i in sorted(calls, key=lambda c: (c[1], c[2])):
        past = [t for t in allowed.setdefault(key, []) if at - t < window]
        if len(past) < limit:
            allowed[key].append(at)
        out.append((key, at, i, len(past) < limit, limit - len(past) - 1 if len(past) < limit else int(window - (at - past[0]))))
    return sorted(out)


def test_rate_limit(spark):
    calls = [(k, float(at), n) for n, (k, at) in enumerate([("a", 0), ("a", 1), ("a", 2), ("a", 9), ("a", 10), ("b", 5), ("a", 11), ("a", 11)])]
    df = spark.createDataFrame(calls, "key string, at double, id long")
    assert sorted(map(tuple, streams.rate_limit(df, 2, 10.0).collect())) == brute(calls, 2, 10.0)


def test_rate_limit_query_and_stream_agree(spark):
    one, two = (sorted(map(tuple, catalog.QUERIES[n](spark, SF).collect())) for n in ("sm_rate_limit", "sm_rate_limit_stream"))
    assert one == two == brute([r[:3] for r in one], 3, 86400.0) and not all(r[3] for r in one)


def test_rate_limit_of_late_calls(spark):
    one, two = (sorted(map(tuple, catalog.QUERIES[n](spark, SF).collect())) for n in ("sm_rate_limit", "sm_rate_limit_live"))
    assert one == two


EVENT = "run_id string, id long, sequence int, event_type string, timestamp timestamp"


def arrive(spark, tmp_path, batches):
    """A stream of the batches, one after another: rows (run, id, sequence, type, hours)."""
    src = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame([(*r[:4], datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=r[4])) for r in rows], EVENT).coalesce(1).write.mode("append").json(src)
        yield spark.readStream.schema(EVENT).json(src)


def test_events_wait_for_those_before_them(spark, tmp_path):
    out = str(tmp_path / "out")
    batches = [
        [("r", 2, 2, "PLAN_APPROVED", 2), ("s", 9, 1, "FIX_APPLIED", 1)], [("r", 1, 1, "ISSUE_DETECTED", 1), ("r", 0, 0, "RUN_CREATED", 0)],  # out of order, but no gap
        [("r", 5, 4, "RUN_COMPLETED", 4), ("s", 8, 0, "RUN_CREATED", 0)], [("t", 1, 0, "RUN_CREATED", 30)], [("r", 6, 5, "ISSUE_DETECTED", 31)], [("t", 2, 1, "FIX_APPLIED", 90)],
    ]
    for stream in arrive(spark, tmp_path, batches):
        streams.drain(streams.watch_invariants(stream, late="24 hours"), f"{out}/rows", f"{out}/state")
    got = sorted(tuple(r)[:3] for r in spark.read.schema(streams.BREACH).parquet(f"{out}/rows").collect())
    assert got == [("r", 4, "gap"), ("r", 5, "after_end"), ("s", 1, "early_fix"), ("t", 1, "early_fix")]


def test_ended_runs_can_be_forgotten(spark, tmp_path):
    for stream in arrive(spark, tmp_path, [[("r", 0, 0, "RUN_COMPLETED", 0)], [("s", 0, 0, "RUN_CREATED", 60)]]):
        streams.drain(streams.watch_invariants(stream, late="24 hours", forget=3600.0), str(tmp_path / "rows"), str(tmp_path / "state"))
    assert [r["key"]["run_id"] for r in spark.read.format("statestore").load(str(tmp_path / "state")).collect()] == ["s"]


def test_tail_drops_ended_runs(spark, tmp_path):
    table = stores.KeyedTable(spark, str(tmp_path / "table"), streams.TAIL, ("run_id",), buckets=2)
    batches = [[("r", 0, 0, "RUN_CREATED", 0), ("r", 1, 1, "FIX_APPLIED", 1), ("s", 0, 0, "RUN_CREATED", 1)], [("r", 2, 2, "RUN_COMPLETED", 2)], [("s", 1, 1, "FIX_APPLIED", 50)], [("s", 2, 2, "FIX_APPLIED", 51)]]
    for stream in arrive(spark, tmp_path, batches):
        streams.drain(streams.ledger_tail_live(stream, late="24 hours"), "", str(tmp_path / "state"), "update", sink=streams.merge_into(table))
    assert sorted(map(tuple, table.read().collect())) == [("r", 3, 1, 2, "RUN_COMPLETED"), ("s", 3, 2, 2, "FIX_APPLIED")]
    state = spark.read.format("statestore").load(str(tmp_path / "state"))
    assert [r["key"]["run_id"] for r in state.collect()] == ["s"]


def test_a_batch_again_counts_once(spark, tmp_path):
    table = stores.KeyedTable(spark, str(tmp_path / "table"), "k string, n long", ("k",), buckets=2)
    sink = streams.merge_into(table, {"n": F.coalesce("o.n", F.lit(0)) + F.col("n.n")})
    for batch_id, rows in ((0, [("a", 1), ("b", 2)]), (1, [("a", 5)]), (1, [("a", 5)])):
        sink(spark.createDataFrame(rows, "k string, n long"), batch_id)
    assert sorted(map(tuple, table.read().collect())) == [("a", 6), ("b", 2)]


def test_one_timer_for_the_calls_of_a_batch():
    class State(list):
        def appendList(self, values):  # noqa: N802
            self.extend(values)

        def put(self, values):
            self[:] = values

        def get(self):
            return iter(list(self))

    class Handle:
        timers = []

        def getListState(self, name, schema):  # noqa: N802
            return State()

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    handle, limiter = Handle(), streams._limiter(2, 10.0)
    limiter.init(handle)
    calls = [(float(at), at) for at in (5, 3, 1, 9, 40, 30, 2)]
    assert list(limiter.handleInputRows(("k",), iter([pd.DataFrame(calls[:4], columns=["at", "id"]), pd.DataFrame(calls[4:], columns=["at", "id"])]), Now(0))) == []
    assert handle.timers == [1001]
    rows = lambda ms: [tuple(r) for df in limiter.handleExpiredTimer(("k",), Now(ms), None) for r in df.itertuples(index=False)]
    assert [r[1:4] for r in rows(20_000)] == [(1.0, 1, True), (2.0, 2, True), (3.0, 3, False), (5.0, 5, False), (9.0, 9, False)]
    assert handle.timers == [1001, 30_001] and rows(25_000) == []
    assert [r[1:4] for r in rows(50_000)] == [(30.0, 30, True), (40.0, 40, True)] and list(limiter.waiting) == []
    rows(handle.timers[-1] + 1)
    assert list(limiter.times) == []
