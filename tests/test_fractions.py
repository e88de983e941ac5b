"""Rounding of fractions on ties that the doubles nearest to them miss."""

import datetime

import duckdb

from tallywright.operators import reliability
from tallywright.plans.metric_queries import _even


def test_confidence_on_a_tie(spark):
    rows = [(1, "fix", 40, 41, 11), (2, "fix", 40, 17, 23), (3, "fix", 8, 7, 1), (4, "fix", 0, 0, 0)]
    got = {r["run_id"]: r["confidence"] for r in reliability.decision_reports(spark.createDataFrame(rows, "run_id int, mode string, before int, after int, fixed int")).collect()}
    assert got == {1: 0.12, 2: 0.58, 3: 0.12, 4: 1.0}
    assert duckdb.sql(f"SELECT {_even('23', '40', 2)}, {_even('5', '40', 2)}, {_even('-7', '16', 1)}").fetchall() == [(0.58, 0.12, -0.4)]


def test_periods_on_a_tie(spark):
    day = lambda n: datetime.datetime(2001, 1, 1) - datetime.timedelta(days=n)
    rows = [(1, day(1), 7.0, 3), (1, day(12), 16.0, 16), (1, day(13), 0.0, 0), (1, day(14), 0.0, 0), (2, day(1), 50.5, 2)]
    t = spark.createDataFrame(rows, "repo_metrics_id int, created_at timestamp, reliability_score double, total_risks int")
    got = {r["repo_metrics_id"]: (r["score_percent"], r["risks_percent"], r["score_before"], r["score"], r["score_change"]) for r in reliability.period_compare(t, "2001-01-01 00:00:00", 10).collect()}
    assert got == {1: (31.2, -43.8, 5.3, 7.0, 1.7), 2: (0.0, 0.0, 0.0, 50.5, 50.5)}
