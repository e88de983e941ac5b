"""Scans of code bases: textual rules over lines, their neighbours, scopes and files.

Lines have repo_id, path, line_no (from 1) and text; files have repo_id, path and content. Null text counts as empty. Every scan
returns hits (repo_id, rule_id, path, line_no, subtype, snippet); all rules of a shape run in one pass over the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .literals import literals
from .scan_rules import BRANCHES, DEADLOCK, FILE_RULES, FIRST_ONLY, LAYERS, LINE_RULES, LOCK_USE, NEAR_RULES, RISKY_INIT, STDLIB, TEST_NAMES

HIT = ("repo_id", "rule_id", "path", "line_no", "subtype", "snippet")

def _file():
    return Window.partitionBy("repo_id", "path").orderBy("line_no")


def _before():
    return _file().rowsBetween(Window.unboundedPreceding, -1)


def _so_far():
    return _file().rowsBetween(Window.unboundedPreceding, 0)


def _text() -> Column:
    return F.col("text")


def _indent() -> Column:
    return F.length(F.regexp_extract("text", r"^(\s*)", 1))


def _lines(lines: DataFrame) -> DataFrame:
    return lines.select("repo_id", "path", "line_no", F.coalesce("text", F.lit("")).alias("text"))


def _all(*conditions: Column | None) -> Column:
    return reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))


def _match(c: Column, need: str = "", skip: str = "") -> Column:
    return _all(c.rlike(need) if need else None, ~c.rlike(skip) if skip else None)


def _found(pattern: str) -> Column:
    """Whether the pattern matches the text; its literals are looked for first, in the text or in its lower case (low)."""
    needed, folded = literals(pattern)
    where = F.col("low") if folded else _text()
    held = reduce(Column.__or__, [where.contains(x) for x in needed]) if needed else None
    return _all(held, _text().rlike(pattern))


def _hits(df: DataFrame, found: Iterable[Column]) -> DataFrame:
    """One row for each of the structs (rule_id, subtype) that is not null on a line."""
    out = df.withColumn("hit", F.explode(F.array_compact(F.array(*found))))
    return out.select("repo_id", "hit.rule_id", "path", "line_no", "hit.subtype", F.col("text").alias("snippet"))


def _named(rule: str, subtype: str | Column = "") -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), (F.lit(subtype) if isinstance(subtype, str) else subtype).alias("subtype"))


def one_rule(df: DataFrame, when: Column, rule: str, subtype: str | Column = "") -> DataFrame:
    return df.where(when).select("repo_id", F.lit(rule).alias("rule_id"), "path", "line_no", (F.lit(subtype) if isinstance(subtype, str) else subtype).alias("subtype"), F.col("text").alias("snippet"))


def scan_lines(lines: DataFrame, rules: Iterable = LINE_RULES) -> DataFrame:
    """Hits of line rules: a projection, without a shuffle. Which rules take a path is worked out once for each pattern of paths, and a
    regular expression runs only on lines that hold a literal that it needs."""
    rules, found, chains = list(rules), [], {}
    paths = {p: f"path_{i}" for i, p in enumerate(dict.fromkeys(p for r in rules for p in (r.paths, r.skip_paths) if p))}
    df = _lines(lines).withColumns({"low": F.lower("text")} | {c: F.col("path").rlike(p) for p, c in paths.items()})
    for r in rules:
        own = [F.col(paths[r.paths]) if r.paths else None, ~F.col(paths[r.skip_paths]) if r.skip_paths else None]
        when = _all(*own, _found(r.need) if r.need else None, _found(r.also) if r.also else None, ~_found(r.skip) if r.skip else None)
        if r.rule in FIRST_ONLY:
            chains[r.rule] = chains[r.rule].when(when, _named(r.rule, r.subtype)) if r.rule in chains else F.when(when, _named(r.rule, r.subtype))
        else:
            found.append(F.when(when, _named(r.rule, r.subtype)))
    return _hits(df, [*found, *chains.values()])


def scan_near(lines: DataFrame, rules: Iterable = NEAR_RULES) -> DataFrame:
    """Hits of rules that look at neighbouring lines: one window over each file for all of them."""
    rules = list(rules)
    back, ahead = max(0, *(-r.low for r in rules)), max(0, *(r.high for r in rules))
    none = F.array().cast("array<string>")
    df = _lines(lines).withColumns({
        "before": F.collect_list("text").over(_file().rowsBetween(-back, -1)) if back else none,
        "after": F.collect_list("text").over(_file().rowsBetween(1, ahead)) if ahead else none,
    }).where(reduce(Column.__or__, [_text().rlike(r.need) for r in rules]))

    def near(low: int, high: int) -> Column:
        parts = []
        if low < 0:
            parts.append(F.slice("before", F.greatest(F.lit(1), F.size("before") + low + 1), F.lit(min(high, -1) - low + 1)))
        if low <= 0 <= high:
            parts.append(F.array(_text()))
        if high > 0:
            parts.append(F.slice("after", F.lit(max(low, 1)), F.lit(high - max(low, 1) + 1)))
        return F.array_join(F.concat(*parts), "\n")

    return _hits(df, [
        F.when(_all(F.col("path").rlike(r.paths) if r.paths else None, _match(_text(), r.need, r.skip), _text().rlike(r.also) if r.also else None,
                    _match(near(r.low, r.high), r.near_need, r.near_skip)), _named(r.rule, r.subtype)) for r in rules
    ])


def scan_files(files: DataFrame, rules: Iterable = FILE_RULES) -> DataFrame:
    """(repo_id, rule_id, path, subtype, matches) of file rules; matches counts them where a rule counts every match, else 1."""
    content = F.coalesce("content", F.lit(""))
    found = [
        F.when(_all(F.col("path").rlike(r.paths) if r.paths else None, _match(content, r.need, r.skip), *[content.rlike(a) for a in r.also]),
               F.struct(F.lit(r.rule).alias("rule_id"), F.lit(r.subtype).alias("subtype"), (F.regexp_count(content, F.lit(r.need)) if r.every else F.lit(1)).cast("long").alias("matches")))
        for r in rules
    ]
    return files.withColumn("hit", F.explode(F.array_compact(F.array(*found)))).select("repo_id", "hit.rule_id", "path", "hit.subtype", "hit.matches")


def nested_loops(lines: DataFrame) -> DataFrame:
    """Loops with less indented loops among the nine lines before; the subtype is the nesting level."""
    df = _lines(lines).withColumn("indent", F.when(_text().contains("for "), _indent()))
    df = df.withColumn("before", F.collect_list("indent").over(_file().rowsBetween(-9, -1)))
    level = 1 + F.size(F.filter("before", lambda i: i < F.col("indent")))
    return one_rule(df, _text().contains("for ") & _text().contains(" in ") & (level >= 2), "sc_nested_loops", level.cast("string"))


def signature_mismatch(lines: DataFrame) -> DataFrame:
    """Constructors with *args or **kwargs below any class line of the file."""
    df = _lines(lines).withColumn("in_class", F.coalesce(F.max(_text().contains("class ")).over(_before()), F.lit(False)))
    return one_rule(df, F.col("in_class") & ~_text().contains("class ") & _text().rlike(r"^\s*def\s+__init__") & _text().rlike(r"\*args|\*\*kwargs"), "sc_sig_mismatch")


def risky_constructors(lines: DataFrame) -> DataFrame:
    """Risky calls from a constructor's first line to the next function."""
    mark = F.when(_text().contains("def __init__"), True).when(_text().rlike(r"^\s*def "), False)
    df = _lines(lines).withColumn("inside", F.last(mark, ignorenulls=True).over(_so_far()))
    return one_rule(df, F.col("inside") & _match(_text(), RISKY_INIT, "try|except"), "sc_init_risky")


def async_blocking(lines: DataFrame) -> DataFrame:
    """Blocking calls up to 49 lines below an async function, before the next function or class."""
    starts = _text().rlike(r"^\s*(def|class|async\s+def)\s+")
    df = _lines(lines).withColumn("scope", F.last(F.when(starts, F.struct(F.col("line_no").alias("at"), _text().rlike(r"^\s*async\s+def\s+\w+").alias("is_async"))), ignorenulls=True).over(_before()))
    kind = F.when(_text().contains("time.sleep("), "sleep").when(_text().contains("requests."), "requests").when(_text().rlike(r"\bopen\("), "open")
    return one_rule(df, F.col("scope.is_async") & (F.col("line_no") - F.col("scope.at") <= 49) & ~starts & kind.isNotNull(), "sc_async_blocking", kind)


def heavy_handlers(lines: DataFrame) -> DataFrame:
    """Heavy work up to 29 lines below a handler, with no function, class or decorator between; each line once."""
    at = lambda c, w: F.last(F.when(c, F.col("line_no")), ignorenulls=True).over(w)
    df = _lines(lines).withColumns({
        "handler": at(_text().rlike(r"@app\.route|@router\.|async def"), _before()), "stop": at(_text().rlike(r"^\s*(def|class|@)"), _so_far()),
    })
    kind = F.when(_text().rlike(r"csv\.(reader|writer)"), "csv").when(_text().contains("json.load"), "json").when(_text().contains("sorted("), "sorted")
    return one_rule(df, (F.col("line_no") - F.col("handler") <= 29) & (F.coalesce("stop", F.lit(0)) <= F.col("handler")) & kind.isNotNull(), "sc_heavy_handler", kind)


def deadlocks(lines: DataFrame) -> DataFrame:
    """Lines that take locks, in files where that happens more than twice."""
    df = _lines(lines).withColumn("n", F.sum(F.regexp_count("text", F.lit(DEADLOCK))).over(Window.partitionBy("repo_id", "path")))
    return one_rule(df, (F.col("n") > 2) & _text().rlike(DEADLOCK), "sc_deadlock")


def _sections(lines: DataFrame, start: Column) -> DataFrame:
    """Lines with the number of the section (from a starting line to the next) that they are in; those before the first are left out."""
    return _lines(lines).withColumn("section", F.sum(start.cast("int")).over(_so_far())).where("section > 0")


def god_classes(lines: DataFrame, least: int = 20) -> DataFrame:
    """(repo_id, path, class_name, line_no, methods, severity): textual classes with that many public methods."""
    stripped, is_class = F.trim("text"), F.col("class_name").isNotNull()
    short = _lines(lines).select(
        "repo_id", "path", "line_no", _indent().alias("indent"), F.when(stripped.startswith("class "), F.regexp_extract(stripped, r"^class\s+(\w+)", 1)).alias("class_name"), stripped.rlike("^def [a-zA-Z0-9]").alias("public"),
        ((stripped != "") & ~stripped.startswith("#") & ~stripped.startswith("def") & ~stripped.startswith("class ")).alias("code"),
    )
    df = short.withColumn("top", F.last(F.when(is_class, F.struct("line_no", "indent", "class_name")), ignorenulls=True).over(_so_far())).where("top IS NOT NULL AND (class_name IS NOT NULL OR public OR code)")
    out_at = F.min(F.when(F.col("code") & (F.col("indent") <= F.col("top.indent")), F.col("line_no"))).alias("out_at")
    inside = F.collect_list(F.when(F.col("public") & (F.col("indent") > F.col("top.indent")), F.col("line_no"))).alias("inside")
    per = df.groupBy("repo_id", "path", "top").agg(out_at, inside)
    kept = F.size(F.filter("inside", lambda n: F.col("out_at").isNull() | (n < F.col("out_at")))).cast("long")
    out = per.select("repo_id", "path", "top.class_name", "top.line_no", kept.alias("methods")).where(F.col("methods") >= least)
    return out.select("repo_id", "path", "class_name", "line_no", "methods", F.when(F.col("methods") > 50, "CRITICAL").when(F.col("methods") > 30, "HIGH").otherwise("MEDIUM").alias("severity"))


def incomplete_constructors(lines: DataFrame) -> DataFrame:
    """(repo_id, path, line_no, uses, assignments): top-level classes that use attributes over twice as often as they assign any."""
    df = _sections(lines, _text().startswith("class "))
    out = df.groupBy("repo_id", "path", "section").agg(
        F.min("line_no").alias("line_no"), F.sum(F.regexp_count("text", F.lit(r"self\.\w+(?!\s*=)"))).alias("uses"), F.sum(F.regexp_count("text", F.lit(r"self\.\w+\s*="))).alias("assignments"),
    )
    return out.where("uses > assignments * 2").drop("section")


def complex_functions(lines: DataFrame, least: int = 5) -> DataFrame:
    """(repo_id, path, line_no, branches): sections from one top-level function to the next with that many branch words below their first line."""
    df = _sections(lines, _text().startswith("def ")).withColumn("first", F.min("line_no").over(Window.partitionBy("repo_id", "path", "section")))
    words = F.when(F.col("line_no") > F.col("first"), F.regexp_count("text", F.lit(BRANCHES))).otherwise(0)
    return df.groupBy("repo_id", "path", F.col("first").alias("line_no")).agg(F.sum(words).alias("branches")).where(F.col("branches") >= least)


def _offsets(lines: DataFrame) -> DataFrame:
    return _lines(lines).withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(_before()), F.lit(0)))


def recursion(lines: DataFrame) -> DataFrame:
    """Functions whose name is called in a later line within 500 characters, without a word of depth there."""
    w = Window.partitionBy("repo_id", "path").orderBy("at").rangeBetween(0, 500)
    df = _offsets(lines).withColumn("ahead", F.collect_list("text").over(w)).where(_text().rlike(r"def\s+\w+\([^)]*\):"))
    start = F.regexp_instr("text", F.lit(r"def\s+\w+\([^)]*\):"))
    df = df.withColumns({"name": F.regexp_extract("text", r"def\s+(\w+)\([^)]*\):", 1), "part": F.substr(F.array_join("ahead", "\n"), start, F.lit(500))})
    rest = F.regexp_replace("part", r"^[^\n]*\n?", "")
    return one_rule(df, rest.contains(F.concat("name", F.lit("("))) & ~F.col("part").contains("depth"), "sc_recursion", F.col("name"))


def long_locks(lines: DataFrame) -> DataFrame:
    """Lines that take a lock with more than 20 line ends in the 1000 characters from their own end."""
    df = _offsets(lines).withColumn("last", F.max("line_no").over(Window.partitionBy("repo_id", "path"))).withColumn("end", F.col("at") + F.length("text"))
    w = Window.partitionBy("repo_id", "path").orderBy("end").rangeBetween(0, 999)
    df = df.withColumn("ends", F.sum((F.col("line_no") < F.col("last")).cast("int")).over(w))
    return one_rule(df, _text().rlike(LOCK_USE) & (F.col("ends") > 20), "sc_lock_long")


def third_party(lines: DataFrame, known: Iterable[str] = STDLIB) -> DataFrame:
    """Imports whose root module is not among the known ones; the subtype is the module."""
    root = F.regexp_extract("text", r"^\s*(?:import|from)\s+(\w+)", 1)
    return one_rule(_lines(lines), (root != "") & ~root.isin(*known), "sc_third_party", root)


def unpinned(lines: DataFrame) -> DataFrame:
    """Lines of requirements files that name a package without a version."""
    return one_rule(_lines(lines), F.col("path").endswith("requirements.txt") & _text().rlike(r"^\s*[a-zA-Z0-9_-]+\s*$"), "sc_unpinned")


def layer_imports(lines: DataFrame, layers: dict[str, int] | None = None) -> DataFrame:
    """Import lines of a file in a lower layer's folder that name a higher layer; the subtype is the pair, and a file's layer the first that its folder names."""
    layers = layers or LAYERS
    folder = F.regexp_extract("path", r"^(.*)/", 1)
    own = F.coalesce(*[F.when(folder.contains(n), F.lit(n)) for n in layers])
    pairs = [F.when((F.col("own") == a) & _text().contains(b), F.lit(f"{a} -> {b}")) for a, i in layers.items() for b, j in layers.items() if i > j]
    df = _lines(lines).where(_text().contains("import") | _text().contains("from")).withColumn("own", own).where("own IS NOT NULL")
    return _hits(df, [F.when(p.isNotNull(), _named("sc_layer_dir", p)) for p in pairs])


def missing_tests(paths: DataFrame) -> DataFrame:
    """(repo_id, path): source files (repo_id, path) for which no file of the repository has one of the six test names."""
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    wanted = F.array(*[F.format_string(n.replace("{}", "%s"), stem) for n in TEST_NAMES])
    sources = paths.select("repo_id", "path").distinct().where(~name.rlike(r"^test_|_test\.|\.test\.|\.spec\."))
    have = paths.select("repo_id", name.alias("name")).distinct()
    tested = sources.select("repo_id", "path", F.explode(wanted).alias("name")).join(have, ["repo_id", "name"], "left_semi")
    return sources.join(tested.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def scan_stats(lines: DataFrame, rules: Iterable = (*LINE_RULES, *NEAR_RULES, *FILE_RULES)) -> DataFrame:
    """(repo_id, rule_id, files, lines) that each family of rules covers: those whose path one of its rules takes."""
    per = lines.groupBy("repo_id", "path").agg(F.count("*").alias("n"))
    families: dict[str, list[Column]] = {}
    for r in rules:
        families.setdefault(r.rule, []).append(_match(F.col("path"), r.paths, getattr(r, "skip_paths", "")))
    taken = [F.when(reduce(Column.__or__, own), F.lit(name)) for name, own in families.items()]
    each = per.withColumn("rule_id", F.explode(F.array_compact(F.array(*taken))))
    return each.groupBy("repo_id", "rule_id").agg(F.count("*").alias("files"), F.sum("n").alias("lines"))


#: Scans that are registered by name: functions of lines that return hits (the columns of HIT).
SCANS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_scan(name: str, scan: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a scan of the user's own, which may use windows and scopes as the ones here do; a name is taken once."""
    if name in SCANS:
        raise ValueError(f"there is a scan {name} already")
    SCANS[name] = scan


def run_scans(lines: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The hits of the registered scans (all, or those named) on lines."""
    return reduce(DataFrame.unionByName, [SCANS[n](lines).select(*HIT) for n in (SCANS if names is None else names)])


for _name, _scan in (
    ("lines", scan_lines), ("near", scan_near), ("nested_loops", nested_loops), ("signature_mismatch", signature_mismatch), ("risky_constructors", risky_constructors), ("async_blocking", async_blocking),
    ("heavy_handlers", heavy_handlers), ("deadlocks", deadlocks), ("recursion", recursion), ("long_locks", long_locks), ("third_party", third_party), ("unpinned", unpinned), ("layer_imports", layer_imports),
):
    register_scan(_name, _scan)
