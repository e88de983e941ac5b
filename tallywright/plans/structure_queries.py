"""Queries of the structural metrics, over code that is written from the orders: a class for each customer, a method for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import scratch_dir
from ..operators import scans
from ..operators import scores as sc
from ..operators import structure as st
from ..sources.fact_store import FactStore
from .registry import Registry
from .views import Views

REGISTRY = Registry()
add = REGISTRY.add
FORMS = (
    "    def m%1$d(self, a, b, c):\n        for x in a:\n            for y in b:\n                assert x and y or c\n",
    '    def test_m%1$d(self):\n        """Doc."""\n        if self.k%1$d:\n            return requests.get(self.u)\n',
    "    def m%1$d(self):\n        self.v%1$d = list(self.k)\n",
)
ORDERS = "(SELECT o_custkey % 20 AS repo_id, 'src/c' || CAST(o_custkey // 20 AS VARCHAR) || '.py' AS path, o_custkey AS c, o_orderkey AS k, o_orderkey % 3 AS form FROM orders)"


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by their key over all shuffle partitions: adaptive execution would merge small texts into few tasks, though parsing them is work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _files(v: Views, orders: DataFrame | None = None):
    key = F.col("o_orderkey")
    method = F.when(key % 3 == 0, F.format_string(FORMS[0], key)).when(key % 3 == 1, F.format_string(FORMS[1], key)).otherwise(F.format_string(FORMS[2], key))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), method.alias("m")))), lambda p: p["m"])
    text = F.concat(F.format_string("class C%d(Base, Other):\n", F.col("o_custkey")), F.array_join(parts, ""))
    return _dealt(v.orders if orders is None else orders, "o_custkey").groupBy("o_custkey").agg(text.alias("content")).select((F.col("o_custkey") % 20).alias("repo_id"), F.format_string("src/c%d.py", F.floor(F.col("o_custkey") / 20)).alias("path"), "content")


def _facts(v: Views, *metrics: str):
    return st.facts(_files(v), *metrics)


def _without_line(df):
    return df.drop("line")


add("st_facts", lambda v: st.kind_counts(_facts(v, "kind_counts")).where("kind IN ('ClassDef', 'FunctionDef', 'For', 'BoolOp', 'Assert', 'Base')"), """
SELECT 'ClassDef' AS kind, count(DISTINCT o_custkey) AS facts FROM orders UNION ALL SELECT 'Base', 2 * count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'FunctionDef', count(*) FROM orders
UNION ALL SELECT 'For', 2 * count(*) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'BoolOp', 2 * count(*) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'Assert', count(*) FROM orders WHERE o_orderkey % 3 = 0""")
add("st_class_size", lambda v: st.class_sizes(_facts(v, "class_sizes"), 40, 12), f"SELECT repo_id, path, 'C' || c AS name, CAST(1 + sum(CASE form WHEN 2 THEN 2 ELSE 4 END) AS INT) AS lines, count(*) AS methods FROM {ORDERS} GROUP BY repo_id, path, c HAVING lines > 40 OR methods > 12")
add("st_god_vars", lambda v: st.instance_variables(_facts(v, "instance_variables"), 5).drop("class_id"), f"SELECT repo_id, path, sum(CASE WHEN form = 0 THEN 0 ELSE 1 END)::BIGINT + max(CASE WHEN form = 1 THEN 1 ELSE 0 END) + max(CASE WHEN form = 2 THEN 1 ELSE 0 END) AS variables FROM {ORDERS} GROUP BY 1, 2 HAVING variables > 5")
add("st_multi_inherit", lambda v: st.multiple_inheritance(_facts(v, "multiple_inheritance")).drop("class_id"), f"SELECT DISTINCT repo_id, path, 2 AS bases FROM {ORDERS}")
add("st_func_size", lambda v: _without_line(st.function_sizes(_facts(v, "function_sizes"))), f"SELECT repo_id, path, 'm' || k AS name, 4 AS lines, 4 AS parameters FROM {ORDERS} WHERE form = 0")
add("st_cyclomatic", lambda v: _without_line(st.cyclomatic(_facts(v, "cyclomatic"), 5)), f"SELECT repo_id, path, 'm' || k AS name, 7 AS complexity, 'MEDIUM' AS severity FROM {ORDERS} WHERE form = 0")
add("st_nested_loop", lambda v: _without_line(st.loop_nesting(_facts(v, "loop_nesting"))), f"SELECT repo_id, path, 2 AS depth, 'MEDIUM' AS severity FROM {ORDERS} WHERE form = 0")
add("st_asserts", lambda v: _without_line(st.calls_and_asserts(_facts(v, "calls_and_asserts"))), f"SELECT repo_id, path, CASE form WHEN 0 THEN 'assert' WHEN 1 THEN 'no_timeout' ELSE 'list' END AS kind FROM {ORDERS}")
add("st_doc_cover", lambda v: st.doc_coverage(_facts(v, "doc_coverage")), f"SELECT repo_id, count(*) FILTER (WHERE form = 1) AS documented, count(*) + 2 * count(DISTINCT c) AS total, count(*) FILTER (WHERE form = 1) / (count(*) + 2 * count(DISTINCT c)) * 100 AS coverage FROM {ORDERS} GROUP BY 1")
add("st_test_quality", lambda v: st.test_quality(_facts(v, "test_quality")), f"SELECT repo_id, path, 'test_m' || k AS name, 'no_assertion' AS problem, 'HIGH' AS severity FROM {ORDERS} WHERE form = 1")
add("gr_nodes", lambda v: st.code_nodes(_facts(v, "code_nodes")), f"""SELECT DISTINCT repo_id, path AS id, 'file' AS node_type, path AS name, path FROM {ORDERS} UNION ALL SELECT DISTINCT repo_id, path || '::C' || c, 'class', 'C' || c, path FROM {ORDERS}
UNION ALL SELECT repo_id, path || '::C' || c || CASE form WHEN 1 THEN '.test_m' ELSE '.m' END || k, 'method', CASE form WHEN 1 THEN 'test_m' ELSE 'm' END || k, path FROM {ORDERS}""")
add("gr_structural_edges", lambda v: st.structural_edges(_facts(v, "structural_edges")), f"""
SELECT DISTINCT repo_id, path AS source_id, path || '::C' || c AS target_id, 'defines' AS edge_type FROM {ORDERS} UNION ALL SELECT DISTINCT repo_id, path || '::C' || c, 'Base', 'inherits' FROM {ORDERS} UNION ALL SELECT DISTINCT repo_id, path || '::C' || c, 'Other', 'inherits' FROM {ORDERS}
UNION ALL SELECT repo_id, path || '::C' || c, path || '::C' || c || CASE form WHEN 1 THEN '.test_m' ELSE '.m' END || k, 'contains' FROM {ORDERS}""")
add("st_coupling", lambda v: _without_line(st.couplings(_facts(v, "couplings"), 7)), f"SELECT repo_id, path, 'C' || c AS name, 2 + max(CASE form WHEN 0 THEN 5 ELSE 0 END) + max(CASE form WHEN 1 THEN 1 ELSE 0 END) + max(CASE form WHEN 2 THEN 1 ELSE 0 END) AS names FROM {ORDERS} GROUP BY repo_id, path, c HAVING names > 7")
add("st_feature_envy", lambda v: _without_line(st.feature_envy(_facts(v, "feature_envy"), 0)), f"SELECT repo_id, path, 'test_m' || k AS name, 'requests' AS root, 1 AS accesses FROM {ORDERS} WHERE form = 1")
add("st_module", lambda v: st.module_checks(_facts(v, "module_checks"), _files(v), code_lines=40, classes=0), f"""
WITH m AS (SELECT repo_id, path, 1 + sum(CASE form WHEN 2 THEN 2 ELSE 4 END) AS code_lines, 0 AS imports, 1 AS classes FROM {ORDERS} GROUP BY 1, 2)
SELECT repo_id, path, 'classes' AS problem, 'MEDIUM' AS severity, code_lines, imports, classes FROM m UNION ALL SELECT repo_id, path, 'lines', 'MEDIUM', code_lines, imports, classes FROM m WHERE code_lines > 40""")
_UNTESTED = lambda v: scans.missing_tests(v.orders.select((F.col("o_custkey") % 20).alias("repo_id"), F.format_string("src/c%d.py", F.floor(F.col("o_custkey") / 20)).alias("path")))
add("st_test_score", lambda v: sc.test_scores(_facts(v, "test_quality"), st.KEY, missing=_UNTESTED(v)), f"""
WITH m AS (SELECT repo_id, count(DISTINCT path) AS n FROM {ORDERS} GROUP BY 1), t AS (SELECT repo_id, path, count(*) AS k FROM {ORDERS} WHERE form = 1 GROUP BY 1, 2)
SELECT t.repo_id, path, 70 - least(k * 5, 40) - least(2 * n, 10) AS score FROM t JOIN m ON m.repo_id = t.repo_id""")
add("st_list_conv", lambda v: _without_line(st.calls_and_asserts(_facts(v, "calls_and_asserts")).where("kind = 'list'")), f"SELECT repo_id, path, 'list' AS kind FROM {ORDERS} WHERE form = 2")
add("st_long_function", lambda v: _without_line(st.function_sizes(_facts(v, "function_sizes"), 3, 1000)), f"SELECT repo_id, path, CASE form WHEN 0 THEN 'm' ELSE 'test_m' END || k AS name, 4 AS lines, CASE form WHEN 0 THEN 4 ELSE 1 END AS parameters FROM {ORDERS} WHERE form <> 2")

#: Code that is written from the order lines: a file for each order, a function for each line.
LINE_FORMS = (
    '    """Doc of f."""\n    for x in a:\n        t = [y for y in x]\n    return t\n',
    "    for x in a:\n        a += x\n",
    '    """Doc of f."""\n    for x in self.rows:\n        db.query(x)\n    raise ValueError\n',
    "    while a.b:\n        a.c = a.k + a.k + a.k + a.k\n",
)
LINES = "(SELECT l_orderkey % 20 AS repo_id, 'src/o' || CAST(l_orderkey AS VARCHAR) || '.py' AS path, l_linenumber AS n, l_linenumber % 4 AS form FROM lineitem)"


def _line_facts(v: Views, *metrics: str):
    form = F.col("l_linenumber") % 4
    body = F.element_at(F.array(*[F.lit(x) for x in LINE_FORMS]), (form + 1).cast("int"))
    text = F.concat(F.format_string("def f%d(", F.col("l_linenumber")), F.when(form == 2, "self").otherwise("a"), F.lit("):\n"), body)
    per = _dealt(v.lineitem, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(text)), "").alias("content"))
    return st.facts(per.select((F.col("l_orderkey") % 20).alias("repo_id"), F.format_string("src/o%d.py", F.col("l_orderkey")).alias("path"), "content"), *metrics)


add("st_loop_smells", lambda v: _without_line(st.loop_smells(_line_facts(v, "loop_smells"))), f"""
SELECT repo_id, path, CASE form WHEN 0 THEN 'list_comprehension' WHEN 1 THEN 'concatenation' WHEN 2 THEN 'query' ELSE 'repeated_attribute' END AS smell,
  CASE form WHEN 2 THEN 'HIGH' WHEN 3 THEN 'LOW' ELSE 'MEDIUM' END AS severity, CASE form WHEN 3 THEN 'a.k' END AS detail FROM {LINES}""")
ISSUES = f"""(SELECT DISTINCT repo_id, path, NULL AS name, 'no_docstring' AS problem, 'MEDIUM' AS severity FROM {LINES} UNION ALL SELECT repo_id, path, 'f' || n, 'no_docstring', 'HIGH' FROM {LINES} WHERE form IN (1, 3)
UNION ALL SELECT repo_id, path, 'f' || n, 'no_parameter_section', 'MEDIUM' FROM {LINES} WHERE form = 0 UNION ALL SELECT repo_id, path, 'f' || n, 'no_return_section', 'MEDIUM' FROM {LINES} WHERE form = 0
UNION ALL SELECT repo_id, path, 'f' || n, 'no_exception_section', 'LOW' FROM {LINES} WHERE form = 2)"""
add("st_doc_issues", lambda v: _without_line(st.doc_issues(_line_facts(v, "doc_issues"))), f"SELECT * FROM {ISSUES}")
add("st_doc_score", lambda v: sc.documentation_scores(_line_facts(v, "doc_issues"), st.KEY), f"""
WITH c AS (SELECT repo_id, path, 100.0 * count(*) FILTER (WHERE form IN (0, 2)) / (count(*) + 1) AS coverage FROM {LINES} GROUP BY 1, 2), i AS (SELECT path, count(*) AS k, count(*) FILTER (WHERE problem = 'no_parameter_section') AS p FROM {ISSUES} GROUP BY 1)
SELECT repo_id, c.path, greatest(0, 100 - CASE WHEN coverage < 50 THEN 30 WHEN coverage < 70 THEN 20 WHEN coverage < 90 THEN 10 ELSE 0 END - least(3 * k, 30) - 2 * least(2 * p, 15)) AS score FROM c JOIN i ON i.path = c.path""")

#: The code in three versions: as of the early orders; with all orders; without the files of one repository in ten.
EARLY = "o_orderdate < '1998-06-01'"


def _fact_store(v: Views) -> FactStore:
    store = FactStore(v.spark, scratch_dir(v.spark))
    store.add(1, _files(v, v.orders.where(EARLY)))
    store.add(2, _files(v))
    store.remove(3, store.files.read().where("repo_id % 10 = 3"))
    return store


add("st_facts_store", lambda v: st.class_sizes(_fact_store(v).read(), 40, 12), f"SELECT repo_id, path, 'C' || c AS name, CAST(1 + sum(CASE form WHEN 2 THEN 2 ELSE 4 END) AS INT) AS lines, count(*) AS methods FROM {ORDERS} WHERE repo_id % 10 <> 3 GROUP BY repo_id, path, c HAVING lines > 40 OR methods > 12")
add("st_facts_parsed", lambda v: _fact_store(v).hashes().groupBy("version").agg(F.count("*").alias("texts")), f"""
WITH e AS (SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE {EARLY}), l AS (SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE NOT ({EARLY}))
SELECT 1 AS version, n AS texts FROM e WHERE n > 0 UNION ALL SELECT 2, n FROM l WHERE n > 0""")

COUNTS = "count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m"
SCORES = " UNION ALL ".join(
    f"SELECT run_id, '{family}' AS family, greatest(0, 100 - {c} * c - {h} * h - {m} * m) AS score FROM (SELECT run_id, {COUNTS} FROM scored_issues WHERE family = '{family}' GROUP BY 1)" for family, (c, h, m) in sc.WEIGHTS.items()
)
for name, family in (("st_sec_score", "security"), ("st_perf_score", "performance"), ("st_arch_score", "architecture")):
    add(name, lambda v, family=family: sc.family_scores(v.scored_issues, "run_id", family), f"SELECT * FROM ({SCORES}) WHERE family = '{family}'")


def _scores(v: Views):
    parts = [sc.family_scores(v.scored_issues, "run_id", family) for family in sc.WEIGHTS]
    return parts[0].union(parts[1]).union(parts[2])


def _families(v: Views):
    return {family: v.scored_issues.where(F.col("family") == family).drop("family") for family in sc.WEIGHTS}


add("st_overall", lambda v: sc.overall(_scores(v), v.scored_issues, "run_id"), f"""
WITH s AS (SELECT run_id, floor(avg(score) + 0.5)::BIGINT AS overall FROM ({SCORES}) GROUP BY 1), i AS (SELECT run_id, {COUNTS} FROM scored_issues GROUP BY 1)
SELECT i.run_id, overall, floor(4 * c + 2 * h + 0.5 * m + 0.5)::BIGINT AS debt_hours, least(100, 25 * c + 10 * h + 5 * m) AS risk FROM i JOIN s ON s.run_id = i.run_id""")
add("st_aggregate", lambda v: sc.breakdown(sc.aggregate(_families(v)), "family", "severity", "severity_rank"), """
SELECT family, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank, count(*) AS issues FROM scored_issues GROUP BY 1, 2""")
