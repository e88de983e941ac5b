"""Projections of the test tables to the shapes that the operators take, as one SQL text for Spark and DuckDB.

Names in braces are other views or tables. Issue ids are numbered within each order, not over the whole table, so that
numbering needs no single partition.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: The moment that stands for "now": for views from orders and lineitem, and for those from events.
AS_OF, AS_OF_EVENTS = "2001-08-02 00:00:00", "2024-01-31 00:00:00"

_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"

#: Lines of code of the fixture; each rule of the scans has one that it hits.
CODE = (
    "import os", "import pkg_resources", "def handler(a, b):", "    async def fetch(self):", "        time.sleep(3)", "    r = requests.get(url)", "    for x in items:", "        rows = db.query(User).all()", "    except:",
    "        pass", 'password = "hunter2"', "    f = open(path)", "while True:", "    ratio = total / count", "    now = datetime.now()", "cache = {}", "class Service:", "    def __init__(self, **kwargs):", "    if len(parts) > 0:",
    "    x = parts[0]", "        for y in x:", "    self.items = []", "    t = threading.Thread(target=work)", "    Thread(target=work).start()", "pool = ThreadPoolExecutor(4)", '    key = os.getenv("KEY")', "timeout = 30",
    '    if ENVIRONMENT == "prod":', "    rows = [u for u in db.session.query(User)]", "    except ValueError as e:", "    if rate == 0.5:", "    except OSError: continue", "    for retry in range(3):", "    conn = sqlite3.connect(path)",
    "def load(a) -> dict:", "    v = other._hidden", "    data = json.load(f)", "    lock.acquire()", "    with lock:", "    await fetch(x)", "    self.cache = {}", "console.log(x)", "const f = (a) => a", "class Widget {",
    'test("adds", () => {', 'describe("nothing", () => {})', "/** A comment. */", '@app.route("/x")', "query = \"SELECT a FROM t WHERE b = '\" + b", "DEBUG = True", "def walk(n):", "    return walk(n - 1)", "port = 8080",
)
_TEXTS = " ".join(f"WHEN {i} THEN '" + x.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'" for i, x in enumerate(CODE))
#: A file's number, which grows with the keys: some 400 lines a file, 10 files a repository, one of them a test of the one before, one JavaScript.
_FILE = "CAST(floor(l_orderkey / 100) AS BIGINT)"
_PATH = "CASE WHEN f % 10 = 8 THEN 'src/test_m' || CAST(f - 1 AS STRING) || '.py' WHEN f % 10 = 9 THEN 'src/m' || CAST(f AS STRING) || '.js' ELSE 'src/m' || CAST(f AS STRING) || '.py' END"

VIEWS = {
    "repositories": """
SELECT c_custkey AS id, c_nationkey AS installation_id, c_name AS repo_full_name, c_acctbal >= 0 AS is_enabled FROM {customer}""",
    "analysis_runs": """
SELECT o_orderkey AS id, o_custkey AS repository_id,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'push' WHEN 1 THEN 'pull_request' ELSE 'pull_request_review' END AS github_event,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'in_progress' END AS status,
  o_orderdate AS created_at, o_orderdate + INTERVAL '60' SECOND AS started_at,
  CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 11 <> 0
       THEN o_orderdate + INTERVAL '60' SECOND + INTERVAL '1' SECOND * CAST(o_orderkey % 600 AS INT) END AS completed_at
FROM {orders}""",
    "analysis_results": f"""
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS id,
  l_orderkey AS run_id, 'src/m' || CAST(l_partkey % 200 AS STRING) || '.py' AS file_path, l_suppkey AS line_number,
  CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN 'F401' WHEN 1 THEN 'E501' WHEN 2 THEN 'W291' WHEN 3 THEN 'F841'
       WHEN 4 THEN 'E711' WHEN 5 THEN 'C901' WHEN 6 THEN 'D100' ELSE 'X999' END AS issue_code,
  CASE l_returnflag WHEN 'A' THEN 'safe' WHEN 'N' THEN 'review' ELSE 'suggestion' END AS category,
  CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 35 THEN 'high' WHEN l_quantity >= 20 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_fixed, l_shipdate AS created_at
FROM {{lineitem}}""",
    "code_fixes": """
SELECT id, id AS result_id, file_path,
  CASE CAST(id % 7 AS INT) WHEN 0 THEN 'proposed' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'applied'
       WHEN 4 THEN 'failed' WHEN 5 THEN 'pending' ELSE 'applied' END AS status,
  CASE CAST(id % 3 AS INT) WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
  CAST(50 + id % 50 AS INT) AS confidence, 'run-' || CAST(run_id AS STRING) AS ledger_run_id, created_at
FROM {analysis_results} WHERE id % 2 = 0""",
    "pr_analyses": """
SELECT r.id, p.repo_full_name, r.id AS pr_number, r.status, r.completed_at,
  CAST(coalesce(s.c, 0) AS BIGINT) AS critical_risks_count, CAST(coalesce(s.h, 0) AS BIGINT) AS high_risks_count,
  CAST(coalesce(s.m, 0) AS BIGINT) AS medium_risks_count
FROM {analysis_runs} r JOIN {repositories} p ON p.id = r.repository_id
LEFT JOIN (SELECT run_id, sum(CASE severity WHEN 'critical' THEN 1 ELSE 0 END) AS c,
                  sum(CASE severity WHEN 'high' THEN 1 ELSE 0 END) AS h,
                  sum(CASE severity WHEN 'medium' THEN 1 ELSE 0 END) AS m
           FROM {analysis_results} GROUP BY run_id) s ON s.run_id = r.id
WHERE r.github_event = 'pull_request'""",
    "risk_snapshots": """
SELECT o_orderkey AS id, o_custkey AS repo_metrics_id, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN 'fix_applied' ELSE 'pr_analysis' END AS snapshot_type,
  CAST(o_orderkey % 4 AS INT) AS critical_risks, CAST(o_orderkey % 6 AS INT) AS high_risks,
  CAST(o_orderkey % 9 AS INT) AS medium_risks, CAST(o_orderkey % 5 AS INT) AS low_risks,
  CAST(o_orderkey % 4 + o_orderkey % 6 + o_orderkey % 9 + o_orderkey % 5 AS INT) AS total_risks,
  CAST(100 - 10 * (o_orderkey % 4) - 5 * (o_orderkey % 6) - 2 * (o_orderkey % 9) AS DOUBLE) - 0.5E0 * (o_orderkey % 5) AS reliability_score
FROM {orders}""",
    "ledger_base": """
SELECT event_id, user_id, ts, event_type AS et,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn,
  count(*) OVER (PARTITION BY user_id) AS n FROM {events}""",
    "ledger_events": """
SELECT event_id AS id, 'run-' || CAST(user_id AS STRING) AS run_id,
  CAST(rn + CASE WHEN user_id % 5 = 0 AND rn * 2 > n THEN 1 ELSE 0 END AS INT) AS sequence, ts AS timestamp,
  CASE WHEN rn = 0 THEN 'RUN_CREATED'
       WHEN rn = n - 1 AND user_id % 7 <> 0 THEN CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'RUN_COMPLETED' WHEN 1 THEN 'RUN_ABORTED' ELSE 'RUN_REJECTED' END
       WHEN et = 'view' THEN 'ISSUE_DETECTED' WHEN et = 'signup' THEN 'PLAN_APPROVED' WHEN et = 'click' THEN 'SAFETY_CHECK_PASSED'
       WHEN et = 'purchase' THEN 'FIX_APPLIED' WHEN event_id % 2 = 0 THEN 'EDR_FINALIZED' ELSE 'POLICY_RESOLVED' END AS event_type,
  CASE WHEN event_id % 3 = 0 THEN 'Human' WHEN event_id % 3 = 1 THEN 'System' ELSE 'Agent' END AS actor_role,
  'actor' || CAST(event_id % 10 AS STRING) AS actor, 'PHASE_' || CAST(1 + event_id % 6 AS STRING) AS phase,
  CASE WHEN event_id % 4 <> 0 THEN 'ref-' || CAST(event_id % 13 AS STRING) END AS payload_ref,
  'event ' || CAST(event_id AS STRING) AS summary
FROM {ledger_base}""",
    "ledger_runs": """
SELECT 'run-' || CAST(user_id AS STRING) AS run_id, 'repo-' || CAST(user_id % 20 AS STRING) AS repo_id,
  CASE WHEN user_id % 4 = 0 THEN 'LEGACY' ELSE 'policy-' || CAST(user_id % 3 AS STRING) END AS run_policy_id,
  min(ts) AS started_at, CASE WHEN user_id % 7 <> 0 THEN max(ts) END AS ended_at,
  CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 11 = 0 THEN 'COMPLETE'
       WHEN user_id % 3 = 0 THEN 'COMPLETE' WHEN user_id % 3 = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'ABORTED' ELSE 'INCOMPLETE' END ELSE 'REJECTED' END AS final_state
FROM {events} GROUP BY user_id""",
    "source_lines": f"""
SELECT repo_id, path, line_no, CASE WHEN f % 10 = 7 AND line_no = 1 THEN 'class Big:' WHEN f % 10 = 7 AND line_no <= 25 + f % 40 THEN '    def m' || CAST(line_no AS STRING) || '(self):'
  WHEN f % 10 = 6 AND line_no = 1 THEN 'class Lazy:' WHEN f % 10 = 6 AND line_no <= 9 THEN '        return self.total + self.rate'
  ELSE CASE CAST(l_partkey % {len(CODE)} AS INT) {_TEXTS} END END AS text
FROM (SELECT CAST(floor(f / 10) AS INT) AS repo_id, {_PATH} AS path, f, l_partkey, CAST(row_number() OVER (PARTITION BY f ORDER BY {_LINE_ORDER}) AS INT) AS line_no
  FROM (SELECT *, {_FILE} AS f FROM {{lineitem}}))""",
    "graph_edges": """
SELECT DISTINCT 'pkg' || CAST(l_partkey % 12 AS STRING) || '.n' || CAST(l_partkey AS STRING) AS source_id,
  'pkg' || CAST((l_suppkey * 7 + l_linenumber) % 12 AS STRING) || '.n' || CAST(l_suppkey * 7 + l_linenumber AS STRING) AS target_id,
  CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'imports' WHEN 1 THEN 'calls' ELSE 'contains' END AS edge_type
FROM {lineitem}""",
    "graph_nodes": """
SELECT id, CASE CAST(length(id) % 3 AS INT) WHEN 0 THEN 'file' WHEN 1 THEN 'class' ELSE 'function' END AS node_type FROM (SELECT source_id AS id FROM {graph_edges} UNION SELECT target_id AS id FROM {graph_edges})""",
    "code_imports": f"""
SELECT CAST(floor(f / 250) AS INT) AS repo_id, 'src/m' || CAST(f % 250 AS STRING) || '.py' AS path,
  CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'src.' WHEN 1 THEN 'lib.' ELSE '' END || 'm' || CAST(l_partkey % 300 AS STRING)
    || CASE WHEN l_linenumber % 3 = 0 AND l_suppkey % 2 = 0 THEN '.Thing' ELSE '' END AS module
FROM (SELECT *, {_FILE} AS f FROM {{lineitem}})""",
    "code_functions": """
SELECT CAST(p_partkey % 2 AS INT) AS repo_id, 'src/m' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) || '.py' AS path, 'g' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) AS name,
  'src/m' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) || '.py::g' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) || '#' || CAST(p_partkey AS STRING) AS id
FROM {part}""",
    "code_calls": """
SELECT CAST(l_orderkey % 2 AS INT) AS repo_id, 'src/m' || CAST(CAST(floor(l_partkey / 41) AS BIGINT) AS STRING) || '.py' AS path, 'src/m' || CAST(CAST(floor(l_partkey / 41) AS BIGINT) AS STRING) || '.py::f' || CAST(l_orderkey AS STRING) AS caller,
  CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'self.' WHEN 1 THEN 'mod.' ELSE '' END || CASE WHEN l_suppkey % 5 = 0 THEN 'h' ELSE 'g' END || CAST(CAST(floor((l_partkey + l_suppkey % 2 * 97) / 3) AS BIGINT) AS STRING) AS name
FROM {lineitem}""",
    "scored_issues": """
SELECT run_id, severity, CASE WHEN issue_code LIKE 'F%' THEN 'security' WHEN issue_code LIKE 'E%' THEN 'performance' ELSE 'architecture' END AS family
FROM {analysis_results}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
_NAME = re.compile(r"\{(\w+)\}")


class Views:
    """The views over the tables of one folder, as DataFrames; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._built = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            if name not in self._built:
                text = VIEWS[name]
                self._built[name] = self.spark.sql(text, **{n: getattr(self, n) for n in set(_NAME.findall(text.replace("{{", "").replace("}}", "")))})
            return self._built[name]
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def source_files(self) -> DataFrame:
        from ..sources.files import files_from_lines

        return files_from_lines(self.source_lines)


#: source_files for DuckDB.
FILES_SQL = "SELECT repo_id, path, string_agg(text, chr(10) ORDER BY line_no) AS content FROM source_lines GROUP BY repo_id, path"


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    texts = {k: _NAME.sub(r"\1", v.replace("{{", "\0").replace("}}", "\1")).replace("\0", "{").replace("\1", "}") for k, v in VIEWS.items()} | {"source_files": FILES_SQL}
    needed: list[str] = []

    def want(text: str) -> None:
        for name in texts:
            if name not in needed and re.search(rf"\b{name}\b", text):
                want(texts[name])
                needed.append(name)

    want(sql)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    chain = ", ".join(f"{n} AS ({texts[n]})" for n in needed)
    if not chain:
        return sql
    if own:
        return f"WITH {own[1] or ''}{chain}, {sql[own.end():]}"
    return f"WITH {chain} {sql}"
