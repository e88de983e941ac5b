"""Analytics over analysis runs, their issues and fixes.

Runs have id, repository_id, github_event, status, created_at, started_at, completed_at; issues (results) have id, run_id,
file_path, issue_code, category, severity, is_fixed (0, 1 or 2), created_at; `as_of` stands for the current moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import or_default, percent, since


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def recent(table: DataFrame, days: int, as_of: str, col: str = "created_at") -> DataFrame:
    """Rows of the last `days` days before as_of."""
    return table.where(F.col(col) >= since(as_of, days))


def issue_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(F.count("*").alias("issues"))


def daily(runs: DataFrame, results: DataFrame, days: int, as_of: str) -> DataFrame:
    """Runs, completed and failed runs and issues of each day, in order of day."""
    per_run = recent(runs, days, as_of).join(issue_counts(results).withColumnRenamed("run_id", "id"), "id", "left")
    out = per_run.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("total"), _count(F.col("status") == "completed").alias("completed"), _count(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues")
    )
    return out.orderBy("day")


def period_totals(runs: DataFrame, results: DataFrame, days: int, as_of: str) -> DataFrame:
    """One row: runs, completed, failed, issues, fixed, unfixed, issues per run (0 without runs)."""
    own = recent(runs, days, as_of)
    a = own.agg(F.count("*").alias("total_runs"), _count(F.col("status") == "completed").alias("completed"), _count(F.col("status") == "failed").alias("failed"))
    b = results.join(own.select(F.col("id").alias("run_id")), "run_id", "left_semi").agg(
        F.count("*").alias("issues"), _count(F.col("is_fixed") == 1).alias("fixed"), _count(F.col("is_fixed") == 0).alias("unfixed")
    )
    average = F.when(F.col("total_runs") > 0, F.col("issues") / F.col("total_runs")).otherwise(F.lit(0.0))
    return a.join(b).withColumn("issues_per_run", average)  # one row each


def category_severity(results: DataFrame) -> DataFrame:
    """Issues of each category and severity; missing ones count as unknown."""
    return results.groupBy(or_default("category", "unknown").alias("category"), or_default("severity", "unknown").alias("severity")).agg(F.count("*").alias("issues"))


def category_maps(results: DataFrame) -> DataFrame:
    """One row for each category: its count and a map of its severities."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "issues"))))
    return category_severity(results).groupBy("category").agg(F.sum("issues").alias("issues"), pairs.alias("severities"))


def severities(results: DataFrame) -> DataFrame:
    """One row: counts of high, medium and low issues, and of all."""
    return results.agg(*[_count(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.count("*").alias("total"))


def health_scores(repositories: DataFrame, runs: DataFrame, results: DataFrame, days: int, as_of: str) -> DataFrame:
    """Score of each repository over the last days: the whole part of success % + 20, less 20 if there is any issue, from 0
    to 100; 100 without runs, and then no trend. The trend improves above 70 % success, else it needs attention. Any number of issues weighs the same, as documented."""
    own = recent(runs, days, as_of)
    issues = results.join(own.select(F.col("id").alias("run_id"), "repository_id"), "run_id").groupBy("repository_id").agg(F.count("*").alias("issues"))
    per = own.groupBy("repository_id").agg(F.count("*").alias("runs"), _count(F.col("status") == "completed").alias("completed"))
    t = repositories.select(F.col("id").alias("repository_id")).join(per, "repository_id", "left").join(issues, "repository_id", "left").fillna(0, ["runs", "completed", "issues"])
    rate = percent(F.col("completed"), F.col("runs"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), (rate + 20 - F.when(F.col("issues") > 0, 20).otherwise(0)).cast("int")))
    return t.select(
        "repository_id", "runs", "issues", F.when(F.col("runs") == 0, 100).otherwise(score).cast("int").alias("score"),
        F.when(F.col("runs") > 0, F.when(rate > 70, "improving").otherwise("needs_attention")).alias("trend"),
    )


def top_issues(results: DataFrame, limit: int, by: tuple[str, ...] = ("issue_code",)) -> DataFrame:
    """The most frequent issues; ties in order of code."""
    return results.groupBy(*by).agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), *by).limit(limit)


def list_runs(runs: DataFrame, repositories: DataFrame, results: DataFrame, limit: int, repository_id: int | None = None, status: str | None = None) -> DataFrame:
    """The newest runs with their repository and number of issues, optionally of one repository or status."""
    if repository_id is not None:
        runs = runs.where(F.col("repository_id") == repository_id)
    if status is not None:
        runs = runs.where(F.col("status") == status)
    named = runs.join(repositories.select(F.col("id").alias("repository_id"), "repo_full_name"), "repository_id").orderBy(F.desc("created_at"), "id").limit(limit)
    return named.join(issue_counts(results).withColumnRenamed("run_id", "id"), "id", "left").select("id", "repo_full_name", "status", "created_at", F.coalesce("issues", F.lit(0)).alias("issues"))


def run_details(runs: DataFrame, repositories: DataFrame, results: DataFrame) -> DataFrame:
    """Every run with its repository's name and the list of its issues."""
    listed = results.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("id", "file_path", "line_number", "issue_code", "severity"))).alias("results"))
    named = runs.join(repositories.select(F.col("id").alias("repository_id"), "repo_full_name"), "repository_id", "left")
    return named.join(listed.withColumnRenamed("run_id", "id"), "id", "left").select("id", "repo_full_name", "status", F.coalesce("results", F.array()).alias("results"))


def repository_health(repositories: DataFrame, runs: DataFrame) -> DataFrame:
    """All-time totals of each repository. The average time sums runs that have both times and divides by all completed runs."""
    took = F.when((F.col("status") == "completed") & F.col("started_at").isNotNull() & F.col("completed_at").isNotNull(), F.unix_timestamp("completed_at") - F.unix_timestamp("started_at"))
    per = runs.groupBy("repository_id").agg(
        F.count("*").alias("total"), _count(F.col("status") == "completed").alias("completed"), _count(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(took), F.lit(0)).alias("seconds")
    )
    t = repositories.select(F.col("id").alias("repository_id")).join(per, "repository_id", "left").fillna(0, ["total", "completed", "failed", "seconds"])
    return t.select("repository_id", "total", "completed", "failed", percent(F.col("completed"), F.col("total")).alias("success_rate"), F.when(F.col("completed") > 0, F.col("seconds") / F.col("completed")).otherwise(0.0).alias("average_seconds"))


def recent_issues(runs: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """The newest k issues of each repository."""
    own = results.join(runs.select(F.col("id").alias("run_id"), "repository_id"), "run_id")
    rank = F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("created_at"), "id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("repository_id", "rank", "id", "issue_code", "created_at")


def issue_summary(results: DataFrame, limit: int, is_fixed: int | None = None, category: str | None = None, severity: str | None = None) -> DataFrame:
    """Of the first `limit` issues (by id) that pass the filters: by code, their number, fixed ones, distinct files and fix rate."""
    for col, value in (("is_fixed", is_fixed), ("category", category), ("severity", severity)):
        if value is not None:
            results = results.where(F.col(col) == value)
    fixed = _count(F.col("is_fixed") == 1)
    return results.orderBy("id").limit(limit).groupBy("issue_code").agg(F.count("*").alias("issues"), fixed.alias("fixed"), F.count_distinct("file_path").alias("files"), percent(fixed, F.count("*")).alias("fix_rate"))


def by_repository(repositories: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    """Repositories that have issues: total, fixed, unfixed, fix rate, counts of the three categories; most issues first."""
    own = results.join(runs.select(F.col("id").alias("run_id"), "repository_id"), "run_id")
    cat = lambda c: _count(F.lower("category") == c).alias(c)
    fixed = _count(F.col("is_fixed") == 1)
    per = own.groupBy("repository_id").agg(
        F.count("*").alias("total"), fixed.alias("fixed"), _count(F.col("is_fixed") == 0).alias("unfixed"), percent(fixed, F.count("*")).alias("fix_rate"), cat("safe"), cat("review"), cat("suggestion")
    )
    named = per.join(repositories.select(F.col("id").alias("repository_id"), "repo_full_name"), "repository_id")
    return named.orderBy(F.desc("total"), "repository_id")


def trending(results: DataFrame, days: int, as_of: str, k: int) -> DataFrame:
    """The most frequent codes of the last days, with the category and severity of their first row."""
    first = lambda c: F.min_by(c, "id").alias(c)
    per = recent(results, days, as_of).groupBy("issue_code").agg(F.count("*").alias("occurrences"), _count(F.col("is_fixed") == 1).alias("fixed"), first("category"), first("severity"))
    return per.orderBy(F.desc("occurrences"), "issue_code").limit(k)


def bulk_fix(results: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """The issues after those that are open and of these codes are marked as fixed, with a flag of what changed."""
    hit = F.col("issue_code").isin(*codes) & (F.col("is_fixed") == 0)
    return results.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn("is_fixed", F.when(F.col("changed"), 1).otherwise(F.col("is_fixed")))


def status_counts(runs: DataFrame) -> DataFrame:
    status = F.col("status")
    return runs.agg(_count(status == "completed").alias("completed"), _count(status == "failed").alias("failed"), _count(~status.isin("completed", "failed")).alias("in_progress"))


def fix_progress(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Per cent of each run's issues that are fixed; 0 without issues."""
    per = results.groupBy(F.col("run_id").alias("id")).agg(_count(F.col("is_fixed") == 1).alias("fixed"), F.count("*").alias("total"))
    return runs.select("id").join(per, "id", "left").select(F.col("id").alias("run_id"), percent(F.coalesce("fixed", F.lit(0)), F.coalesce("total", F.lit(0))).alias("fix_percent"))


def fix_status(fixes: DataFrame) -> DataFrame:
    """Fixes of each run by status; pending and generated count as proposed."""
    s = F.when(F.col("status").isin("pending", "generated"), "proposed").otherwise(F.col("status"))
    return fixes.groupBy("ledger_run_id").agg(*[_count(s == x).alias(x) for x in ("proposed", "approved", "rejected", "applied", "failed")])


def results_with_fixes(results: DataFrame, fixes: DataFrame) -> DataFrame:
    """Every issue with the number of its fixes, whether it has any, and the first one's status."""
    per = fixes.groupBy(F.col("result_id").alias("id")).agg(F.count("*").alias("fixes"), F.min_by("status", "id").alias("first_status"), F.sort_array(F.collect_list("id")).alias("fix_ids"))
    return results.select("id", "issue_code").join(per, "id", "left").select("id", "issue_code", F.coalesce("fixes", F.lit(0)).alias("fixes"), F.col("fixes").isNotNull().alias("has_fix"), "first_status")


def newest_per(table: DataFrame, key: str, at: str, tie: str, k: int) -> DataFrame:
    """The newest k rows of each key, ranked."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), tie))).where(F.col("rank") <= k)


def run_log_stats(log: DataFrame) -> DataFrame:
    """Totals of a run log (issues, fixes, errors array, duration, success): average duration to 2 places (missing: 0), success in per cent to 1."""
    n = F.count("*")
    return log.agg(
        n.alias("runs"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"), F.coalesce(F.sum("fixes"), F.lit(0)).alias("fixes"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"),
        F.bround(F.avg(F.coalesce("duration", F.lit(0.0))), 2).alias("average_duration"), F.bround(percent(_count(F.col("success")), n), 1).alias("success_percent"),
    )


def merge_languages(*tables: DataFrame) -> DataFrame:
    """The issues of several scans (file_path, line_number, issue_code, language), python by default, in order of file and line."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.withColumn("language", or_default("language", "python")).orderBy("file_path", "line_number", "issue_code")


def language_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("language").agg(F.count("*").alias("issues"))


#: Language of a file's extension. Fixed values.
EXTENSIONS = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}


def detect_languages(files: DataFrame) -> DataFrame:
    """(repo_id, language): the languages of a repository's files by extension; python where none is known."""
    ext = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    lang = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        lang = F.when(F.lower(ext) == e, name).otherwise(lang)
    found = files.groupBy("repo_id").agg(F.collect_set(lang).alias("found"))
    return found.select("repo_id", F.explode(F.when(F.size("found") == 0, F.array(F.lit("python"))).otherwise(F.col("found"))).alias("language"))
