"""Reliability scores, their time series, and reports on single reviews and runs.

Pull request analyses have repo_full_name, pr_number, status, completed_at and three risk counts; snapshots have
repo_metrics_id, created_at, four risk counts, total_risks and reliability_score. Rounding is half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_join
from ..functions.lineage import numbered

from ..functions.scalars import clamp, fraction_even, ratio, since

SEVERITIES = ("critical", "high", "medium", "low")


def score(critical: Column, high: Column, medium: Column, low: Column, adoption: Column) -> Column:
    """100, less 10, 5, 2 and a half for each risk, plus 10 times the adoption rate; from 0 to 100, two places."""
    raw = F.lit(100.0) - critical * 10 - high * 5 - medium * 2 - low * 0.5 + adoption * 10
    return F.bround(clamp(raw, 0.0, 100.0), 2)


def grade(s: Column) -> Column:
    return F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F")


def pr_counters(prs: DataFrame) -> DataFrame:
    """Reviews of each repository: all, those with a critical risk, and those with a high one but no critical one."""
    c, h = F.col("critical_risks_count") > 0, F.col("high_risks_count") > 0
    return prs.groupBy("repo_full_name").agg(F.count("*").alias("total_prs"), F.count_if(c).alias("prs_critical"), F.count_if(~c & h).alias("prs_high"))


def risk_rollup(repositories: DataFrame, prs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Risks of each repository's reviews completed in the last days, zero where there are none; low ones are not recorded."""
    own = prs.where((F.col("status") == "completed") & (F.col("completed_at") >= since(as_of, days)))
    sums = own.groupBy("repo_full_name").agg(*[F.sum(f"{s}_risks_count").alias(s) for s in SEVERITIES[:3]])
    return repositories.select("id", "repo_full_name").join(sums, "repo_full_name", "left").select("id", "repo_full_name", *[F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITIES[:3]], F.lit(0).cast("long").alias("low"))


def fix_funnel(repositories: DataFrame, runs: DataFrame, results: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes of each repository: proposed, approved and applied each hold the later states too; adoption and success rates."""
    owner = results.select(F.col("id").alias("result_id"), F.col("run_id")).join(runs.select(F.col("id").alias("run_id"), "repository_id"), "run_id")
    n = lambda *states: F.count_if(F.col("status").isin(*states))
    per = fixes.join(owner, "result_id").groupBy(F.col("repository_id").alias("id")).agg(
        n("proposed", "approved", "applied").alias("proposed"), n("approved", "applied").alias("approved"), n("applied").alias("applied"), n("failed").alias("failed")
    )
    t = repositories.select("id").join(per, "id", "left").fillna(0, ["proposed", "approved", "applied", "failed"])
    return t.withColumns({"adoption_rate": ratio(F.col("applied"), F.col("proposed")), "success_rate": ratio(F.col("applied"), F.col("applied") + F.col("failed"))})


def metrics(repositories: DataFrame, runs: DataFrame, results: DataFrame, fixes: DataFrame, prs: DataFrame, as_of: str, snapshots: DataFrame | None = None) -> DataFrame:
    """One row for each repository: risks of 30 days, fix funnel, counters, score and grade; 100 and A where nothing is known.
    With snapshots, also the change of the score since the latest snapshot of 7 and of 30 days before (null without one)
    and the trend of the total risks since then."""
    t = risk_rollup(repositories, prs, as_of).join(fix_funnel(repositories, runs, results, fixes), "id").join(pr_counters(prs), "repo_full_name", "left").fillna(0, ["total_prs", "prs_critical", "prs_high"])
    new = (F.col("total_prs") == 0) & (F.col("proposed") + F.col("failed") == 0)
    s = F.when(new, 100.0).otherwise(score(*[F.col(x) for x in SEVERITIES], F.col("adoption_rate")))
    t = t.withColumn("score", s).withColumn("grade", grade(F.col("score")))
    if snapshots is None:
        return t
    at = lambda c, n: F.max_by(c, F.when(F.col("created_at") <= since(as_of, n), F.struct("created_at", "id"))).alias(f"{c}_{n}")
    past = snapshots.groupBy(F.col("repo_metrics_id").alias("id")).agg(*[at(c, n) for c in ("reliability_score", "total_risks") for n in (7, 30)])
    total = F.col("critical") + F.col("high") + F.col("medium") + F.col("low")
    t = t.join(past, "id", "left").withColumns({f"score_change_{n}d": F.col("score") - F.col(f"reliability_score_{n}") for n in (7, 30)} | {f"risk_trend_{n}d": risk_trend(total, F.col(f"total_risks_{n}")) for n in (7, 30)})
    return t.drop(*[f"{c}_{n}" for c in ("reliability_score", "total_risks") for n in (7, 30)])


def as_of_changes(snapshots: DataFrame, as_of: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """The current score (latest snapshot at or before as_of) less the one of so many days before; null without one."""
    at = lambda n: F.max_by("reliability_score", F.when(F.col("created_at") <= since(as_of, n), F.struct("created_at", "id")))
    per = snapshots.groupBy("repo_metrics_id").agg(at(0).alias("now"), *[at(n).alias(f"d{n}") for n in days])
    return per.select("repo_metrics_id", F.col("now").alias("score"), *[(F.col("now") - F.col(f"d{n}")).alias(f"change_{n}d") for n in days])


def changes_at_snapshots(snapshots: DataFrame, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(id, repo_metrics_id, score, change_7d, ..): of every snapshot the change of the score since the latest snapshot that was there so
    many days before it; null without one."""
    score = ("reliability_score",)
    out = snapshots.select("id", "repo_metrics_id", "created_at", F.col("reliability_score").alias("score"))
    for n in days:
        past = asof_join(out, snapshots, "repo_metrics_id", F.col("created_at") - F.expr(f"INTERVAL {n} DAYS"), F.col("created_at"), ("id",), score)
        out = past.withColumn(f"change_{n}d", F.col("score") - F.col("found.reliability_score")).drop("found")
    return out.drop("created_at")


def risk_trend(now: Column, past: Column) -> Column:
    """increasing or decreasing beyond 10 per cent; stable where the past is zero or missing."""
    change = (now - past) / past * 100
    return F.when(past.isNull() | (past == 0), "stable").when(change > 10, "increasing").when(change < -10, "decreasing").otherwise("stable")


def risk_trends(snapshots: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The label of each repository's total risks now against those of so many days before."""
    at = lambda n: F.max_by("total_risks", F.when(F.col("created_at") <= since(as_of, n), F.struct("created_at", "id")))
    per = snapshots.groupBy("repo_metrics_id").agg(at(0).alias("now"), at(days).alias("past"))
    return per.select("repo_metrics_id", risk_trend(F.col("now"), F.col("past")).alias("risk_trend"))


def pr_snapshots(prs: DataFrame) -> DataFrame:
    """A snapshot of each completed review: low is 0, and the total their sum."""
    c = [F.col(f"{s}_risks_count") for s in SEVERITIES[:3]]
    own = prs.where("status = 'completed'")
    return own.select("id", "repo_full_name", F.col("completed_at").alias("created_at"), F.lit("pr_analysis").alias("snapshot_type"), *[x.alias(f"{s}_risks") for x, s in zip(c, SEVERITIES, strict=False)], F.lit(0).alias("low_risks"), (c[0] + c[1] + c[2]).alias("total_risks"))


def fix_snapshots(fixes: DataFrame, results: DataFrame, runs: DataFrame, current: DataFrame) -> DataFrame:
    """A snapshot for each applied fix, of its repository's current metrics (id, critical, high, medium, low, score); the total is the sum of all four."""
    owner = results.select(F.col("id").alias("result_id"), "run_id").join(runs.select(F.col("id").alias("run_id"), "repository_id"), "run_id").select("result_id", "repository_id")
    own = fixes.where("status = 'applied'").select(F.col("id").alias("code_fix_id"), "result_id", "created_at").join(owner, "result_id")
    now = current.select(F.col("id").alias("repository_id"), *[F.col(s).alias(f"{s}_risks") for s in SEVERITIES], F.col("score").alias("reliability_score"))
    total = F.col("critical_risks") + F.col("high_risks") + F.col("medium_risks") + F.col("low_risks")
    return own.join(now, "repository_id").select("code_fix_id", "repository_id", "created_at", F.lit("fix_applied").alias("snapshot_type"), *[f"{s}_risks" for s in SEVERITIES], total.alias("total_risks"), "reliability_score")


def score_trend(snapshots: DataFrame, as_of: str, days: int) -> DataFrame:
    own = snapshots.where(F.col("created_at") >= since(as_of, days))
    return own.select("repo_metrics_id", "created_at", "reliability_score", "id").orderBy("repo_metrics_id", "created_at", "id")


def risk_series(snapshots: DataFrame, as_of: str, days: int) -> DataFrame:
    """(repo_metrics_id, id, created_at, severity, risks): four series."""
    own = snapshots.where(F.col("created_at") >= since(as_of, days))
    return own.unpivot(["repo_metrics_id", "id", "created_at"], [f"{s}_risks" for s in SEVERITIES], "severity", "risks").withColumn("severity", F.regexp_replace("severity", "_risks$", ""))


def velocity(snapshots: DataFrame, as_of: str, days: int) -> DataFrame:
    """Change of the score, and fall of the risks, for each point (not each day) of the last days; 0 with fewer than two points."""
    at = F.struct("created_at", "id")
    end = lambda f, c: f(c, at)
    per = snapshots.where(F.col("created_at") >= since(as_of, days)).groupBy("repo_metrics_id").agg(
        F.count("*").alias("points"), (end(F.max_by, "reliability_score") - end(F.min_by, "reliability_score")).alias("ds"), (end(F.min_by, "total_risks") - end(F.max_by, "total_risks")).alias("dr")
    )
    rate = lambda c: F.when(F.col("points") >= 2, F.bround(F.col(c) / F.col("points"), 2)).otherwise(0.0)
    return per.select("repo_metrics_id", "points", rate("ds").alias("score_velocity"), rate("dr").alias("risk_velocity"))


def forecast(snapshots: DataFrame, as_of: str, history: int, ahead: int) -> DataFrame:
    """The score so many days ahead, by its velocity: repositories with 7 points or more; low confidence under 14."""
    now = snapshots.groupBy("repo_metrics_id").agg(F.max_by("reliability_score", F.struct("created_at", "id")).alias("now"))
    t = velocity(snapshots, as_of, history).where("points >= 7").join(now, "repo_metrics_id")
    return t.select(
        "repo_metrics_id", F.bround(clamp(F.col("now") + F.col("score_velocity") * ahead, 0.0, 100.0), 1).alias("forecast"), F.when(F.col("points") < 14, "low").otherwise("medium").alias("confidence")
    )


def period_compare(snapshots: DataFrame, as_of: str, days: int) -> DataFrame:
    """Averages of the last period (open to the right) and the one before it, with changes absolute and in per cent (0 on a base of 0).
    Scores count to two places; averages and changes are rounded as the fractions they are, so that ties do not hang on doubles."""
    t, cut = F.col("created_at"), since(as_of, days)
    a, b = t >= cut, (t >= since(as_of, 2 * days)) & (t < cut)
    whole = {"s": F.bround(F.col("reliability_score") * 100).cast("long"), "r": F.col("total_risks").cast("long")}
    parts = [x for c, v in whole.items() for i, w in ((1, a), (0, b)) for x in (F.coalesce(F.sum(F.when(w, v)), F.lit(0)).alias(f"{c}{i}"), F.greatest(F.count(F.when(w, v)), F.lit(1)).alias(f"n{c}{i}"))]
    per = snapshots.groupBy("repo_metrics_id").agg(*parts, F.count_if(a).alias("points"), F.count_if(b).alias("points_before"))

    def compared(c: str, name: str, unit: int) -> list[Column]:
        s1, n1, s0, n0 = (F.col(x).cast("decimal(38,0)") for x in (f"{c}1", f"n{c}1", f"{c}0", f"n{c}0"))
        rise = s1 * n0 - s0 * n1
        percent = F.when(s0 != 0, fraction_even(rise * 100, s0 * n1, 1)).otherwise(0.0)
        return [fraction_even(s1, n1 * unit, 1).alias(name), fraction_even(s0, n0 * unit, 1).alias(f"{name}_before"), fraction_even(rise, n1 * n0 * unit, 1).alias(f"{name}_change"), percent.alias(f"{name}_percent")]

    return per.select("repo_metrics_id", "points", "points_before", *compared("s", "score", 100), *compared("r", "risks", 1))


def period_scores(snapshots: DataFrame, unit: str) -> DataFrame:
    """Rollup of each repository and day, week or month: averages, reviews, fixes, and the change to the period before."""
    n = F.count("*")
    mean = lambda c: F.sum(F.col(c).cast("double")) / n
    per = snapshots.groupBy("repo_metrics_id", F.date_trunc(unit, "created_at").alias("period")).agg(
        mean("reliability_score").alias("score"), mean("critical_risks").alias("critical"), mean("high_risks").alias("high"), mean("total_risks").alias("risks"),
        F.count_if(F.col("snapshot_type") == "pr_analysis").alias("prs"), F.count_if(F.col("snapshot_type") == "fix_applied").alias("fixes"),
    )
    past = F.lag("score").over(Window.partitionBy("repo_metrics_id").orderBy("period"))
    return per.withColumn("change", F.col("score") - past)


def hotspots(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Counters of each repository's files, their main category (ties: the first by name), first and last sight, and the weight of their risks
    with their rank. Files are ranked by ranges, so that a repository with very many of them is ranked in many tasks."""
    own = results.join(runs.select(F.col("id").alias("run_id"), "repository_id"), "run_id")
    n = {s: F.count_if(F.col("severity") == s) for s in SEVERITIES}
    per = own.groupBy("repository_id", "file_path").agg(
        F.count("*").alias("issues"), *[c.alias(s) for s, c in n.items()], F.count_if(F.col("is_fixed") == 1).alias("fixes"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ("review", "safe", "suggestion")],
    )
    most = F.greatest("n_review", "n_safe", "n_suggestion")
    main = F.when(F.col("n_review") == most, "review").when(F.col("n_safe") == most, "safe").otherwise("suggestion")
    weight = F.col("critical") * 10.0 + F.col("high") * 5 + F.col("medium") * 2 + F.col("low") * 0.5
    ranked = numbered(per.withColumn("primary_category", main).withColumn("hotspot_score", weight).withColumn("_least", -F.col("hotspot_score")), "repository_id", "_least", "file_path", name="rank")
    return ranked.drop("_least").withColumn("rank", F.col("rank").cast("int"))


def hotspot_maps(spots: DataFrame) -> DataFrame:
    """The category breakdown of hotspots as a map."""
    return spots.select("repository_id", "file_path", F.create_map(*[x for c in ("review", "safe", "suggestion") for x in (F.lit(c), F.col(f"n_{c}"))]).alias("categories"))


def run_counts(results: DataFrame) -> DataFrame:
    """Issues of each run, all and by severity."""
    return results.groupBy("run_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def verdict() -> Column:
    """Of the counts of one review."""
    return F.when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "concerning").when(F.col("medium") > 0, "good").otherwise("excellent")


def pr_verdicts(results: DataFrame) -> DataFrame:
    return run_counts(results).withColumn("verdict", verdict())


def check_conclusions(results: DataFrame) -> DataFrame:
    c = F.when(F.col("verdict") == "critical", "failure").when(F.col("verdict") == "concerning", "neutral").otherwise("success")
    return pr_verdicts(results).select("run_id", c.alias("conclusion"))


def pr_digest(results: DataFrame) -> DataFrame:
    """The first 5 critical (text cut to 200) and first 3 high (150) issues of each run, with how many more there are."""
    own = results.where(F.col("severity").isin("critical", "high"))
    w = Window.partitionBy("run_id", "severity")
    most = F.when(F.col("severity") == "critical", 5).otherwise(3)
    text = F.concat("issue_code", F.lit(" in "), "file_path")
    ranked = own.withColumns({"rank": F.row_number().over(w.orderBy("id")), "n": F.count("*").over(w)}).where(F.col("rank") <= most)
    cut = F.when(F.col("severity") == "critical", F.substring(text, 1, 200)).otherwise(F.substring(text, 1, 150))
    return ranked.select("run_id", "severity", "rank", "id", cut.alias("statement"), F.greatest(F.lit(0), F.col("n") - most).alias("more"))


def decision_reports(runs: DataFrame) -> DataFrame:
    """Of runs (run_id, mode, before, after, fixed, rules): confidence, risk level and title.

    Confidence is 0 for a run that only analyses, 1 if there was nothing before, else the share of issues fixed in per cent,
    less 15 after a regression, from 0 to 100, over 100, to two places of the exact fraction. The risk is high after a regression, medium with more
    than 50 issues left, else by the number fixed: low under 10, medium under 50, high from there."""
    worse, fixed = F.col("after") > F.col("before"), F.col("fixed")
    all_of = F.col("before").cast("long") * 100
    share = F.least(F.greatest(fixed.cast("long") * 100 - F.when(worse, F.col("before").cast("long") * 15).otherwise(0), F.lit(0)), all_of)
    conf = F.when(F.col("mode") == "analyze", 0.0).when(F.col("before") == 0, 1.0).otherwise(fraction_even(share, all_of, 2))
    risk = F.when(worse, "high").when(F.col("after") > 50, "medium").when(fixed < 10, "low").when(fixed < 50, "medium").otherwise("high")
    n = fixed.cast("string")
    title = F.when(F.col("mode") == "analyze", "Code analysis completed (preview mode)").when(fixed == 0, "No issues were auto-fixed").when(worse, F.concat(F.lit("Fixed "), n, F.lit(" issues (regressions detected)")))
    title = title.when(fixed == 1, "Fixed 1 code issue").otherwise(F.concat(F.lit("Fixed "), n, F.lit(" code issues")))
    return runs.withColumn("confidence", conf).withColumn("risk_level", risk).withColumn("title", title)


def scan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_id, new_codes, fixed_codes, net, status): distinct codes that only one of two scans (run_id, issue_code) has; net is the change in issues, and more of them give a warning."""
    n = lambda df, name: df.groupBy("run_id", "issue_code").agg(F.count("*").alias(name))
    both = n(before, "b").join(n(after, "a"), ["run_id", "issue_code"], "full_outer").fillna(0, ["a", "b"])
    per = both.groupBy("run_id").agg(F.count_if(F.col("b") == 0).alias("new_codes"), F.count_if(F.col("a") == 0).alias("fixed_codes"), (F.sum("a") - F.sum("b")).alias("net"))
    return per.withColumn("status", F.when(F.col("net") > 0, "warning").otherwise("ok"))


def code_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy("issue_code").agg(F.count("*").alias(name))
    return n(before, "before").join(n(after, "after"), "issue_code", "full_outer").fillna(0, ["before", "after"])
