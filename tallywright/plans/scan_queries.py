"""Queries of the code scans; SQL for rules of lines, neighbours and files comes from the same rows of the rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan_rules as rules
from ..operators import scans
from .registry import Registry
from .views import Views

REGISTRY = Registry()
add = REGISTRY.add
W = "OVER (PARTITION BY repo_id, path ORDER BY line_no"
BEFORE = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(column: str, need: str, skip: str = "") -> list[str]:
    """Conditions for DuckDB; a guard that looks ahead is expressed by taking guarded calls out first."""
    out = []
    if "(?!" in need:
        call, guard = need.split("(?!")
        out.append(f"regexp_matches(regexp_replace({column}, {_q(call + guard[:-1])}, '', 'g'), {_q(call)})")
    elif need:
        out.append(f"regexp_matches({column}, {_q(need)})")
    return out + ([f"NOT regexp_matches({column}, {_q(skip)})"] if skip else [])


def _hit_sql(rule: str, subtype: str, when: list[str], source: str = "source_lines") -> str:
    return f"SELECT repo_id, {_q(rule)} AS rule_id, path, line_no, {_q(subtype)} AS subtype, text AS snippet FROM {source} WHERE {' AND '.join(when)}"


def _rule_sql(name: str) -> str:
    out, earlier = [], []
    for r in rules.LINE_RULES:
        if r.rule == name:
            when = _re("path", r.paths, r.skip_paths) + _re("text", r.need, r.skip) + (_re("text", r.also) if r.also else [])
            out.append(_hit_sql(name, r.subtype, when + (earlier if name in rules.FIRST_ONLY else [])))
            earlier = [*earlier, f"NOT ({' AND '.join(when)})"]
    for r in rules.NEAR_RULES:
        if r.rule == name:
            side = lambda n: f"{abs(n)} {'PRECEDING' if n <= 0 else 'FOLLOWING'}"
            near = f"(SELECT *, coalesce(string_agg(text, chr(10)) {W} ROWS BETWEEN {side(r.low)} AND {side(r.high)}), '') AS near FROM source_lines)"
            when = _re("path", r.paths) + _re("text", r.need, r.skip) + (_re("text", r.also) if r.also else []) + _re("near", r.near_need, r.near_skip)
            out.append(_hit_sql(name, r.subtype, when, near))
    return " UNION ALL ".join(out)


def _rule(name: str):
    line, near = [r for r in rules.LINE_RULES if r.rule == name], [r for r in rules.NEAR_RULES if r.rule == name]

    def run(v: Views):
        parts = ([scans.scan_lines(v.source_lines, line)] if line else []) + ([scans.scan_near(v.source_lines, near)] if near else [])
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    return run


for _name in dict.fromkeys(r.rule for r in (*rules.LINE_RULES, *rules.NEAR_RULES)):
    add(_name, _rule(_name), _rule_sql(_name))
add("sc_all_lines", lambda v: scans.scan_lines(v.source_lines).groupBy("rule_id", "subtype").agg(F.count("*").alias("hits")), "SELECT rule_id, subtype, count(*) AS hits FROM (" + " UNION ALL ".join(
    _rule_sql(n) for n in dict.fromkeys(r.rule for r in rules.LINE_RULES if r.rule not in {x.rule for x in rules.NEAR_RULES})) + " UNION ALL " + " UNION ALL ".join(
    _hit_sql(r.rule, r.subtype, _re("path", r.paths, r.skip_paths) + _re("text", r.need, r.skip) + (_re("text", r.also) if r.also else [])) for r in rules.LINE_RULES if r.rule in {x.rule for x in rules.NEAR_RULES}) + ") GROUP BY 1, 2")


def _file_sql(name: str, source: str = "source_files") -> str:
    return " UNION ALL ".join(
        f"SELECT repo_id, {_q(name)} AS rule_id, path, {_q(r.subtype)} AS subtype, CAST({f'len(regexp_extract_all(content, {_q(r.need)}))' if r.every else 1} AS BIGINT) AS matches FROM {source} WHERE "
        + " AND ".join(_re("path", r.paths) + _re("content", r.need, r.skip) + [c for a in r.also for c in _re("content", a)]) for r in rules.FILE_RULES if r.rule == name)


def _file_rule(name: str):
    return lambda v: scans.scan_files(v.source_files, [r for r in rules.FILE_RULES if r.rule == name])


def _readmes(v: Views):
    return v.documents.select(F.lit(0).alias("repo_id"), F.concat(F.lit("README"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


for _name in dict.fromkeys(r.rule for r in rules.FILE_RULES if r.rule != "sc_readme"):
    add(_name, _file_rule(_name), _file_sql(_name))
add("sc_readme", lambda v: scans.scan_files(_readmes(v), [r for r in rules.FILE_RULES if r.rule == "sc_readme"]), _file_sql("sc_readme", "(SELECT 0 AS repo_id, 'README' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS content FROM documents)"))

add("sc_nested_loops", lambda v: scans.nested_loops(v.source_lines), f"""
WITH a AS (SELECT *, len(regexp_extract(text, '^(\\s*)', 1)) AS i FROM source_lines), b AS (SELECT x.repo_id, x.path, x.line_no, x.text, 1 + count(y.line_no) AS level FROM a x LEFT JOIN a y
  ON y.repo_id = x.repo_id AND y.path = x.path AND y.line_no BETWEEN x.line_no - 100 AND x.line_no - 1 AND y.rn BETWEEN x.rn - 9 AND x.rn - 1 AND contains(y.text, 'for ') AND y.i < x.i
  WHERE contains(x.text, 'for ') AND contains(x.text, ' in ') GROUP BY ALL)
SELECT repo_id, 'sc_nested_loops' AS rule_id, path, line_no, CAST(level AS VARCHAR) AS subtype, text AS snippet FROM b WHERE level >= 2""".replace("FROM source_lines)", f"FROM (SELECT *, row_number() {W}) AS rn FROM source_lines))").replace("BETWEEN x.line_no - 100 AND x.line_no - 1", "< x.line_no"))  # fmt: skip
add("sc_sig_mismatch", lambda v: scans.signature_mismatch(v.source_lines), _hit_sql("sc_sig_mismatch", "", ["c > 0", "NOT contains(text, 'class ')", *_re("text", r"^\s*def\s+__init__"), *_re("text", r"\*args|\*\*kwargs")], f"(SELECT *, sum(CASE WHEN contains(text, 'class ') THEN 1 ELSE 0 END) {BEFORE} AS c FROM source_lines)"))
add("sc_init_risky", lambda v: scans.risky_constructors(v.source_lines), _hit_sql("sc_init_risky", "", ["a >= coalesce(b, 0)", *_re("text", rules.RISKY_INIT, "try|except")],
    f"(SELECT *, max(CASE WHEN contains(text, 'def __init__') THEN line_no END) {W}) AS a, max(CASE WHEN regexp_matches(text, '^\\s*def ') AND NOT contains(text, 'def __init__') THEN line_no END) {W}) AS b FROM source_lines)"))
_ASYNC = f"""(SELECT *, max(CASE WHEN regexp_matches(text, '^\\s*async\\s+def\\s+\\w+') THEN line_no END) {BEFORE} AS a, max(CASE WHEN regexp_matches(text, '^\\s*(def|class)\\s+') THEN line_no END) {BEFORE} AS b,
  CASE WHEN contains(text, 'time.sleep(') THEN 'sleep' WHEN contains(text, 'requests.') THEN 'requests' WHEN regexp_matches(text, '\\bopen\\(') THEN 'open' END AS kind FROM source_lines)"""
add("sc_async_blocking", lambda v: scans.async_blocking(v.source_lines), f"SELECT repo_id, 'sc_async_blocking' AS rule_id, path, line_no, kind AS subtype, text AS snippet FROM {_ASYNC} WHERE kind IS NOT NULL AND a > coalesce(b, 0) AND line_no - a <= 49 AND NOT regexp_matches(text, '^\\s*(def|class|async\\s+def)\\s+')")
add("sc_heavy_handler", lambda v: scans.heavy_handlers(v.source_lines), f"""SELECT repo_id, 'sc_heavy_handler' AS rule_id, path, line_no, kind AS subtype, text AS snippet FROM (SELECT *, max(CASE WHEN regexp_matches(text, '@app\\.route|@router\\.|async def') THEN line_no END) {BEFORE} AS a,
  max(CASE WHEN regexp_matches(text, '^\\s*(def|class|@)') THEN line_no END) {W}) AS b, CASE WHEN regexp_matches(text, 'csv\\.(reader|writer)') THEN 'csv' WHEN contains(text, 'json.load') THEN 'json' WHEN contains(text, 'sorted(') THEN 'sorted' END AS kind FROM source_lines) WHERE kind IS NOT NULL AND line_no - a <= 29 AND a >= coalesce(b, 0)""")
add("sc_deadlock", lambda v: scans.deadlocks(v.source_lines), _hit_sql("sc_deadlock", "", ["n > 2", *_re("text", rules.DEADLOCK)], f"(SELECT *, sum(len(regexp_extract_all(text, {_q(rules.DEADLOCK)}))) OVER (PARTITION BY repo_id, path) AS n FROM source_lines)"))
add("sc_god_class", lambda v: scans.god_classes(v.source_lines), f"""
WITH a AS (SELECT *, trim(text, ' ') AS t, len(regexp_extract(text, '^(\\s*)', 1)) AS i, sum(CASE WHEN starts_with(trim(text, ' '), 'class ') THEN 1 ELSE 0 END) {W}) AS section FROM source_lines),
b AS (SELECT *, min(CASE WHEN starts_with(t, 'class ') THEN i END) OVER (PARTITION BY repo_id, path, section) AS base FROM a WHERE section > 0),
c AS (SELECT *, max(CASE WHEN i <= base AND t <> '' AND NOT regexp_matches(t, '^(#|def|class )') THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, path, section ORDER BY line_no) AS gone FROM b)
SELECT repo_id, path, regexp_extract(max(CASE WHEN starts_with(t, 'class ') THEN t END), '^class\\s+(\\w+)', 1) AS class_name, min(line_no) AS line_no, CAST(count(*) FILTER (WHERE gone = 0 AND i > base AND regexp_matches(t, '^def [a-zA-Z0-9]')) AS BIGINT) AS methods,
  CASE WHEN methods > 50 THEN 'CRITICAL' WHEN methods > 30 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM c GROUP BY repo_id, path, section HAVING methods >= 20""")
add("sc_incomplete_init", lambda v: scans.incomplete_constructors(v.source_lines), f"""
WITH s AS (SELECT *, sum(CASE WHEN starts_with(text, 'class ') THEN 1 ELSE 0 END) {W}) AS section FROM source_lines), g AS (SELECT repo_id, path, min(line_no) AS line_no,
  CAST(sum(len(regexp_extract_all(text, 'self\\.\\w+')) - len(regexp_extract_all(text, 'self\\.\\w\\s*='))) AS BIGINT) AS uses, CAST(sum(len(regexp_extract_all(text, 'self\\.\\w+\\s*='))) AS BIGINT) AS assignments FROM s WHERE section > 0 GROUP BY repo_id, path, section)
SELECT * FROM g WHERE uses > assignments * 2""")
add("sc_complex_func", lambda v: scans.complex_functions(v.source_lines), f"""
WITH s AS (SELECT *, sum(CASE WHEN starts_with(text, 'def ') THEN 1 ELSE 0 END) {W}) AS section FROM source_lines), f AS (SELECT *, min(line_no) OVER (PARTITION BY repo_id, path, section) AS first FROM s WHERE section > 0)
SELECT repo_id, path, first AS line_no, CAST(sum(len(regexp_extract_all(text, '{rules.BRANCHES}'))) FILTER (WHERE line_no > first) AS BIGINT) AS branches FROM f GROUP BY ALL HAVING branches >= 5""")
_AT = f"(SELECT *, coalesce(sum(length(text) + 1) {BEFORE}, 0) AS pos FROM source_lines)"
add("sc_recursion", lambda v: scans.recursion(v.source_lines), f"""
WITH f AS (SELECT repo_id, path, line_no, text, regexp_extract(text, 'def\\s+(\\w+)\\([^)]*\\):', 1) AS name FROM source_lines WHERE regexp_matches(text, 'def\\s+\\w+\\([^)]*\\):')),
g AS (SELECT f.*, string_agg(l.text, chr(10) ORDER BY l.line_no) AS ahead FROM f JOIN source_lines l ON l.repo_id = f.repo_id AND l.path = f.path AND l.line_no BETWEEN f.line_no AND f.line_no + 200 GROUP BY ALL),
p AS (SELECT *, substr(ahead, 1 + length(regexp_extract(text, '^(.*?)def\\s+\\w+\\([^)]*\\):', 1)), 500) AS part FROM g)
SELECT repo_id, 'sc_recursion' AS rule_id, path, line_no, name AS subtype, text AS snippet FROM p WHERE contains(part, chr(10)) AND contains(substr(part, strpos(part, chr(10)) + 1), name || '(') AND NOT contains(part, 'depth')""")
add("sc_lock_long", lambda v: scans.long_locks(v.source_lines), _hit_sql("sc_lock_long", "", [*_re("text", rules.LOCK_USE), "n > 20"], f"(SELECT *, sum(CASE WHEN line_no < m THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, path ORDER BY pos + length(text) RANGE BETWEEN CURRENT ROW AND 999 FOLLOWING) AS n FROM (SELECT *, max(line_no) OVER (PARTITION BY repo_id, path) AS m FROM {_AT}))"))
_ROOT = "regexp_extract(text, '^\\s*(import|from)\\s+(\\w+)', 2)"
add("sc_third_party", lambda v: scans.third_party(v.source_lines), f"SELECT repo_id, 'sc_third_party' AS rule_id, path, line_no, {_ROOT} AS subtype, text AS snippet FROM source_lines WHERE {_ROOT} NOT IN ('', {', '.join(map(_q, rules.STDLIB))})")
add("sc_unpinned", lambda v: scans.unpinned(v.source_lines.withColumn("path", F.replace("path", F.lit(".py"), F.lit("/requirements.txt")))), _hit_sql("sc_unpinned", "", ["ends_with(path, 'requirements.txt')", *_re("text", r"^\s*[a-zA-Z0-9_-]+\s*$")], "(SELECT repo_id, replace(path, '.py', '/requirements.txt') AS path, line_no, text FROM source_lines)"))
add("sc_layer_dir", lambda v: scans.layer_imports(v.source_lines.withColumn("path", F.concat(F.lit("storage/"), "path")), {"pkg": 0, "storage": 2}), _hit_sql("sc_layer_dir", "storage -> pkg", ["contains(text, 'import')", "contains(text, 'pkg')"], "(SELECT repo_id, 'storage/' || path AS path, line_no, text FROM source_lines)"))
add("sc_missing_tests", lambda v: scans.missing_tests(v.source_lines.select("repo_id", "path")), """
WITH p AS (SELECT DISTINCT repo_id, path, split_part(path, '/', -1) AS name FROM source_lines), s AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM p WHERE NOT regexp_matches(name, '^test_|_test\\.|\\.test\\.|\\.spec\\.'))
SELECT repo_id, path FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.repo_id = s.repo_id AND p.name IN ('test_' || stem || '.py', stem || '_test.py', stem || '.test.js', stem || '.test.ts', stem || '.spec.js', stem || '.spec.ts'))""")
_FAMILIES: dict[str, list[str]] = {}
for _r in (*rules.LINE_RULES, *rules.NEAR_RULES, *rules.FILE_RULES):
    _FAMILIES.setdefault(_r.rule, []).append(" AND ".join(_re("path", _r.paths, getattr(_r, "skip_paths", ""))) or "true")
add("sc_stats", lambda v: scans.scan_stats(v.source_lines), "WITH n AS (SELECT repo_id, path, count(*) AS k FROM source_lines GROUP BY 1, 2) " + " UNION ALL ".join(
    f"SELECT repo_id, {_q(name)} AS rule_id, count(*) AS files, CAST(sum(k) AS BIGINT) AS lines FROM n WHERE {' OR '.join(dict.fromkeys(f'({w})' for w in own))} GROUP BY 1" for name, own in _FAMILIES.items()))
add("sc_registered", lambda v: scans.run_scans(v.source_lines, ("nested_loops", "async_blocking", "third_party")).groupBy("rule_id").agg(F.count("*").alias("hits")), " UNION ALL ".join(
    f"SELECT rule_id, count(*) AS hits FROM ({REGISTRY.plain[name]}) GROUP BY 1" for name in ("sc_nested_loops", "sc_async_blocking", "sc_third_party")))
