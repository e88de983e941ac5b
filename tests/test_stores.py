"""Stored tables: appends, merges, what they rewrite and what they leave."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tallywright.functions.lineage import numbered
from tallywright.operators import ledger
from tallywright.sources import stores

EVENT = "run_id string, id long, sequence long, event_type string, summary string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def incoming(spark, given):
    return spark.createDataFrame([(r, i, k, s) for r, i, k, s in given], "run_id string, id long, event_type string, summary string").repartition(3)


def test_appends(spark, tmp_path):
    log = stores.EventLog(spark, str(tmp_path / "log"), EVENT, buckets=4)
    assert log.read().count() == 0
    first = incoming(spark, [("a", 5, "X", "s" * 1200), ("a", 2, "X", "t"), ("b", 1, "X", None), (None, 9, "X", "u")])
    second = incoming(spark, [("a", 1, "RUN_COMPLETED", "u"), ("a", 7, "X", "late"), ("c", 1, "X", "v"), ("b", 3, "X", "w")])
    log.append(1, first)
    log.append(2, second)
    want = [("a", 2, 0), ("a", 5, 1), ("a", 1, 2), ("b", 1, 0), ("b", 3, 1), ("c", 1, 0)]
    assert rows(log.read(), "run_id", "id", "sequence") == sorted(want)
    log.append(1, first)  # the same batches again
    log.append(2, second)
    assert rows(log.read(), "run_id", "id", "sequence") == sorted(want)
    log.append(3, incoming(spark, [("a", 20, "X", "sealed"), ("c", 4, "X", "v")]))
    assert rows(log.read(), "run_id", "id", "sequence") == sorted([*want, ("c", 4, 1)])
    assert rows(log.read(since=3), "run_id", "version") == [("c", 3)]
    assert max(len(r["summary"] or "") for r in log.read().collect()) == stores.SUMMARY


def test_an_append_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    log = stores.EventLog(spark, str(tmp_path / "log"), EVENT, buckets=4)
    log.append(1, incoming(spark, [("a", 1, "X", "")]))
    with monkeypatch.context() as m:
        m.setattr(stores.KeyedTable, "merge", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            log.append(2, incoming(spark, [("a", 2, "X", "")]))
    assert rows(log.read(), "id") == [(1,)]
    log.append(2, incoming(spark, [("a", 2, "X", "")]))
    assert rows(log.read(), "id", "sequence") == [(1, 0), (2, 1)]


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/part-*", recursive=True)}


def test_merges_leave_other_buckets(spark, tmp_path):
    table = stores.KeyedTable(spark, str(tmp_path / "t"), "id long, status string, n long", ("id",), buckets=8)
    table.merge(0, spark.range(200).select("id", F.lit("new").alias("status"), (F.col("id") * 2).alias("n")))
    before = files(table.path)
    wrote = table.merge(1, spark.createDataFrame([(3, "done"), (7, "new"), (500, "extra")], "id long, status string"))
    own = spark.createDataFrame([(3,), (500,)], "id long").select(stores.bucket_of(("id",), 8).alias("b")).distinct().collect()
    assert wrote == sorted(r["b"] for r in own)  # a change that changes nothing rewrites nothing
    after = files(table.path)
    assert before.items() <= after.items()
    got = {r["id"]: (r["status"], r["n"]) for r in table.read().collect()}
    assert len(got) == 201 and got[3] == ("done", 6) and got[7] == ("new", 14) and got[500] == ("extra", None)
    assert table.merge(1, spark.createDataFrame([(3, "done"), (7, "new"), (500, "extra")], "id long, status string")) == wrote
    assert {r["id"]: (r["status"], r["n"]) for r in table.read().collect()} == got
    assert table.read(before=1).count() == 200
    assert table.merge(2, spark.createDataFrame([(900, "x")], "id long, status string"), only_matched=True) == [] and table.read().count() == 201
    table.merge(3, spark.createDataFrame([(3, 5), (901, 1)], "id long, n long"), {"n": F.coalesce("o.n", F.lit(0)) + F.col("n.n")})
    got = {r["id"]: (r["status"], r["n"]) for r in table.read().collect()}
    assert got[3] == ("done", 11) and got[901] == (None, 1)
    plan = table._rows(None, [wrote[0]])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and f"bucket" in plan.split("PartitionFilters")[1][:300]


def test_null_keys_and_empty_changes(spark, tmp_path):
    table = stores.KeyedTable(spark, str(tmp_path / "t"), "id string, x int", ("id",), buckets=2)
    assert table.merge(0, spark.createDataFrame([], "id string, x int")) == [] and table.read().count() == 0
    table.merge(1, spark.createDataFrame([(None, 1), ("a", 2)], "id string, x int"))
    table.merge(2, spark.createDataFrame([(None, 5)], "id string, x int"))
    assert sorted(map(str, table.read().collect())) == sorted(["Row(id=None, x=5)", "Row(id='a', x=2)"])


def test_replay_in_steps_equals_a_full_replay(spark, tmp_path):
    kinds = ["ISSUE_DETECTED", "PLAN_APPROVED", "FIX_APPLIED", "EDR_FINALIZED", "RUN_ABORTED", "RUN_COMPLETED"]
    e = spark.range(400).select("id", F.concat(F.lit("r"), (F.col("id") % 7).cast("string")).alias("run_id"), (F.floor(F.col("id") / 7) + F.floor(F.col("id") / 100)).cast("int").alias("sequence"), F.element_at(F.array(*map(F.lit, kinds)), (1 + F.col("id") % 6).cast("int")).alias("event_type"), F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("payload_ref"))
    runs = e.select("run_id").distinct().select("run_id", F.lit("ABORTED").alias("final_state"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"))
    states = stores.KeyedTable(spark, str(tmp_path / "s"), ledger.REPLAY_STATE, ("run_id",), buckets=2)
    for k, (a, b) in enumerate(((0, 13), (13, 14), (14, 1000))):
        states.merge(k, ledger.fold(e.where(f"sequence >= {a} AND sequence < {b}")), ledger.fold_onto())
    assert sorted(map(str, ledger.replayed(states.read(), runs).collect())) == sorted(map(str, ledger.replay(e, runs).collect()))


def test_numbered_splits_a_large_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).alias("k"), (F.col("id") * 37 % 1000).alias("o"))
    got = numbered(df, "k", "o").collect()
    by = {}
    for r in sorted(got, key=lambda r: (str(r["k"]), r["o"])):
        by.setdefault(r["k"], []).append(r["at"])
    assert len(got) == 1000 and all(v == list(range(1, len(v) + 1)) for v in by.values())


def test_asof_join(spark):
    import datetime as dt

    from tallywright.functions.asof import asof_join

    day = lambda d, s=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=s)
    right = [("a", day(0), 1, "x"), ("a", day(0), 2, "y"), ("a", day(100), 3, "z"), ("a", day(100, 5), 4, None), ("b", day(3), 5, "w"), (None, day(1), 6, "no"), ("a", None, 7, "no")]
    left = [("a", day(-1)), ("a", day(0)), ("a", day(0, 1)), ("a", day(99)), ("a", day(100)), ("a", day(400)), ("b", day(2)), ("b", day(3)), ("c", day(9)), (None, day(9)), ("a", None), ("a", day(99))]
    r = spark.createDataFrame(right, "k string, t timestamp, id int, v string")
    out = asof_join(spark.createDataFrame(left, "k string, at timestamp"), r, "k", F.col("at"), F.col("t"), ("id",), ("id", "v"), block=86_400 * 30)

    def brute(k, at):
        hits = [(t, i, v) for rk, t, i, v in right if rk is not None and rk == k and t is not None and at is not None and t <= at]
        return max(hits, key=lambda h: h[:2])[1:] if hits else None

    got = sorted(((r["k"], r["at"], tuple(r["found"]) if r["found"] else None) for r in out.collect()), key=str)
    assert got == sorted(((k, at, brute(k, at)) for k, at in left), key=str)
