"""Scores of repositories, from issues (key columns, family, severity in small letters) and from facts of code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import structure as st

#: What a critical, a high and a medium issue take off the score of a family. Fixed values.
WEIGHTS = {"security": (20, 10, 5), "performance": (0, 15, 5), "architecture": (0, 12, 6)}
#: Severities, gravest first. Fixed values.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES[:3]]


def family_scores(issues: DataFrame, key: str, family: str) -> DataFrame:
    """(key, family, score): 100 less the family's weights for its issues, at least 0; keys without an issue of the family are left out."""
    critical, high, medium = WEIGHTS[family]
    per = issues.where(F.col("family") == family).groupBy(key).agg(*_severity_counts())
    score = F.greatest(F.lit(0), 100 - F.col("critical") * critical - F.col("high") * high - F.col("medium") * medium)
    return per.select(key, F.lit(family).alias("family"), score.cast("long").alias("score"))


def documentation_scores(f: DataFrame, by: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """(by, score) from facts: 100 less 30, 20 or 10 for a coverage below 50, 70 or 90 per cent, less capped penalties for issues and missing sections."""
    problems = st.doc_issues(f).groupBy(*by).agg(F.count("*").alias("issues"), *[F.count_if(F.col("problem") == f"no_{k}_section").alias(k) for k in ("parameter", "return")])
    named = F.col("kind").isin("FunctionDef", "ClassDef", "Module") & ~((F.col("kind") == "FunctionDef") & F.col("name").rlike("^_(?!_)"))
    per = f.where(named).groupBy(*by).agg((F.count_if("flag") / F.count("*") * 100).alias("coverage")).join(problems, list(by), "left").na.fill(0, ["issues", "parameter", "return"])
    band = F.when(F.col("coverage") < 50, 30).when(F.col("coverage") < 70, 20).when(F.col("coverage") < 90, 10).otherwise(0)
    off = band + F.least(F.col("issues") * 3, F.lit(30)) + F.least(F.col("parameter") * 2, F.lit(15)) + F.least(F.col("return") * 2, F.lit(15))
    return per.select(*by, F.greatest(F.lit(0), 100 - off).cast("long").alias("score"))


def test_scores(f: DataFrame, by: tuple[str, ...] = ("repo_id",), smells: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """(by, score) from facts, where there are test functions: 100 less 5 for each problem (40 at most), less 30 times the share of
    tests without an assertion, rounded down, less 3 for each smell (20 at most) and 2 for each source file of the repository
    without a test file (10 at most). smells: rows with the columns by, one for each; missing: rows (repo_id, path)."""
    problems = st.test_quality(f).groupBy(*by).agg(F.count("*").alias("issues"), F.count_if(F.col("problem") == "no_assertion").alias("bare"))
    tests = f.where((F.col("kind") == "FunctionDef") & F.col("name").startswith("test")).groupBy(*by).agg(F.count("*").alias("tests"))
    per = tests.join(problems, list(by), "left").na.fill(0, ["issues", "bare"])
    for rows, key, name in ((smells, list(by), "smells"), (missing, ["repo_id"], "missing")):
        per = per.withColumn(name, F.lit(0)) if rows is None else per.join(rows.groupBy(*key).agg(F.count("*").alias(name)), key, "left").na.fill(0, [name])
    off = F.least(F.col("issues") * 5, F.lit(40)) + F.floor(F.col("bare") * 30 / F.col("tests")) + F.least(F.col("smells") * 3, F.lit(20)) + F.least(F.col("missing") * 2, F.lit(10))
    return per.select(*by, F.greatest(F.lit(0), 100 - off).cast("long").alias("score"))


def aggregate(parts: dict[str, DataFrame]) -> DataFrame:
    """The issues of all families (by name) with family and severity_rank (0: gravest; unknown severities: 999), to be ordered by that rank."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("family", F.lit(name)) for name, df in parts.items()])
    rank = F.coalesce(*[F.when(F.lower("severity") == s, i) for i, s in enumerate(SEVERITIES)], F.lit(999))
    return whole.withColumn("severity_rank", rank)


def breakdown(issues: DataFrame, *by: str) -> DataFrame:
    """(by, issues): the number of issues by any columns."""
    return issues.groupBy(*by).agg(F.count("*").alias("issues"))


def overall(scores: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """(key, overall, debt_hours, risk): the mean score of the families, rounded half up; 4, 2 and a half hours for a critical, high
    and medium issue, rounded half up; 25, 10 and 5 for each, at most 100. Keys without a score have 0."""
    per = issues.groupBy(key).agg(*_severity_counts())
    mean = scores.groupBy(key).agg(F.floor(F.avg("score") + 0.5).alias("overall"))
    debt = F.floor(F.col("critical") * 4 + F.col("high") * 2 + F.col("medium") * 0.5 + 0.5)
    risk = F.least(F.lit(100), F.col("critical") * 25 + F.col("high") * 10 + F.col("medium") * 5)
    t = per.join(mean, key, "full").na.fill(0, ["critical", "high", "medium", "overall"])
    return t.select(key, F.col("overall").cast("long").alias("overall"), debt.cast("long").alias("debt_hours"), risk.cast("long").alias("risk"))
