"""Queries over code graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut, scratch_dir
from ..operators import graph as gr
from ..sources import files
from .registry import Registry
from .views import Views

REGISTRY = Registry()
add = REGISTRY.add
NODES = "SELECT source_id AS id FROM graph_edges UNION SELECT target_id FROM graph_edges"
LAYERS = (("n1", 1), ("n2", 2), ("pkg3", 3))


def _nodes(v: Views):
    return gr.nodes_of(v.graph_edges)


add("src_lines", lambda v: files.lines(v.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))), """
WITH c AS (SELECT doc_id AS path, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents), d AS (SELECT path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM c)
SELECT path, unnest(range(1, len(l) + 1))::INT AS line_no, unnest(l) AS text FROM d""")


def _code_files(v: Views):
    """Each file of the fixture as a text file of its own, in the folder of its repository, read back from there."""
    path = scratch_dir(v.spark)
    files.write_files(v.source_files.select(F.col("repo_id").alias("folder"), F.regexp_replace("path", "[/.]", "_").alias("name"), "content"), path)
    return files.code_files(v.spark, path, ("txt",)).select(files.file_name().alias("file"), F.sha2("content", 256).alias("sha256"))


_report = lambda: F.struct(F.col("file_path").alias("filename"), F.struct(F.col("line_number").cast("int").alias("row")).alias("location"), F.col("issue_code").alias("code"), F.concat(F.lit('say "'), "severity", F.lit('"')).alias("message"))
_message = lambda: F.struct(F.col("issue_code").alias("ruleId"), F.col("line_number").cast("int").alias("line"), F.when(F.col("severity") == "critical", 2).otherwise(1).alias("severity"), F.col("category").alias("message"))


def _flat(v: Views):
    return files.lint_flat(v.analysis_results.groupBy("run_id").agg(F.to_json(F.collect_list(_report())).alias("report")))


def _nested(v: Views):
    per = v.analysis_results.groupBy("run_id", "file_path").agg(F.collect_list(_message()).alias("messages"))
    return files.lint_nested(per.groupBy("run_id").agg(F.to_json(F.collect_list(F.struct(F.col("file_path").alias("filePath"), "messages"))).alias("report")))


def _webhooks(v: Views):
    k, repo = F.col("o_orderkey"), F.struct(F.format_string("Customer#%09d", F.col("o_custkey")).alias("full_name"))
    pr = F.to_json(F.struct(F.when(k % 3 == 0, "closed").when(k % 3 == 1, "opened").otherwise("synchronize").alias("action"), repo.alias("repository"), F.struct(F.when(k % 5 != 0, k).alias("number"), F.struct(F.sha2(k.cast("string"), 256).alias("sha")).alias("head")).alias("pull_request")))
    push = F.to_json(F.struct(F.when(k % 8 != 0, F.sha2(k.cast("string"), 256)).alias("after"), F.lit("refs/heads/main").alias("ref"), repo.alias("repository")))
    sent = v.orders.select(F.col("o_orderkey").cast("string").alias("delivery_id"), F.when(k % 4 == 0, "push").otherwise("pull_request").alias("event"), F.when(k % 4 == 0, push).otherwise(pr).alias("payload"))
    return files.webhooks(sent.union(sent.where("delivery_id LIKE '%7'")))


add("src_code_files", _code_files, "SELECT replace(replace(path, '/', '_'), '.', '_') AS file, sha256(content || chr(10)) AS sha256 FROM source_files")
add("src_lint_py", _flat, "SELECT file_path AS filename, CAST(line_number AS INT) AS line, issue_code AS code, 'say \"' || severity || '\"' AS message, CASE WHEN starts_with(issue_code, 'E') THEN 'error' ELSE 'warning' END AS severity FROM analysis_results")
add("src_lint_js", _nested, "SELECT file_path AS filename, CAST(line_number AS INT) AS line, issue_code AS code, category AS message, CASE WHEN severity = 'critical' THEN 'error' ELSE 'warning' END AS severity FROM analysis_results")
add("src_webhooks", _webhooks, """
WITH w AS (SELECT CAST(o_orderkey AS VARCHAR) AS delivery_id, o_orderkey AS k, o_orderkey % 4 = 0 AS push, printf('Customer#%09d', o_custkey) AS repo_full_name FROM orders)
SELECT delivery_id, CASE WHEN push THEN 'push' ELSE 'pull_request' END AS event, CASE WHEN NOT push THEN CASE WHEN k % 3 = 1 THEN 'opened' ELSE 'synchronize' END END AS action, repo_full_name, CASE WHEN NOT push THEN CAST(k AS INT) END AS pr_number, sha256(CAST(k AS VARCHAR)) AS head_sha,
  CASE WHEN push THEN 'refs/heads/main' END AS ref FROM w WHERE CASE WHEN push THEN k % 8 <> 0 ELSE k % 3 <> 0 AND k % 5 <> 0 END""")
add("gr_deps", lambda v: gr.neighbours(v.graph_edges, _nodes(v)), "SELECT DISTINCT source_id AS id, target_id AS neighbour FROM graph_edges")
add("gr_callers", lambda v: gr.neighbours(v.graph_edges, _nodes(v), "calls", incoming=True), "SELECT DISTINCT target_id AS id, source_id AS neighbour FROM graph_edges WHERE edge_type = 'calls'")
add("gr_by_type", lambda v: gr.by_type(v.graph_edges, "imports"), "SELECT * FROM graph_edges WHERE edge_type = 'imports'")
add("gr_nodes_by_type", lambda v: gr.by_type(v.graph_nodes, "class", "node_type"), "SELECT * FROM graph_nodes WHERE node_type = 'class'")
add("gr_summary", lambda v: gr.summary(v.graph_nodes, v.graph_edges), "SELECT 'node' AS part, node_type AS type, count(*) AS count FROM graph_nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM graph_edges GROUP BY 2")
def _impact(v: Views):
    edges = cut(v.graph_edges)
    return gr.impact(edges, gr.nodes_of(edges))


add("gr_impact", _impact, """
WITH s AS (SELECT source_id AS id FROM graph_edges UNION SELECT target_id FROM graph_edges), one AS (SELECT DISTINCT s.id AS seed, e.source_id AS id FROM s JOIN graph_edges e ON e.target_id = s.id),
two AS (SELECT DISTINCT o.seed, e.source_id AS id FROM one o JOIN graph_edges e ON e.target_id = o.id)
SELECT seed, id, 1 AS distance FROM one WHERE seed <> id UNION ALL SELECT seed, id, 2 AS distance FROM two WHERE seed <> id AND NOT EXISTS (SELECT 1 FROM one WHERE one.seed = two.seed AND one.id = two.id)""")
add("gr_import_graph", lambda v: gr.import_graph(v.source_lines), "SELECT DISTINCT repo_id, path, regexp_extract(text, '^\\s*(import|from)\\s+([A-Za-z][A-Za-z0-9_]*)', 2) AS module FROM source_lines WHERE regexp_matches(text, '^\\s*(import|from)\\s+[A-Za-z]')")
E1 = "SELECT DISTINCT source_id AS s, target_id AS t FROM graph_edges WHERE source_id <> target_id"
add("gr_cycles", lambda v: gr.cycles(v.graph_edges.where("edge_type = 'imports'"), 5), """
WITH RECURSIVE e AS (SELECT DISTINCT source_id AS s, target_id AS t FROM graph_edges WHERE source_id <> target_id AND edge_type = 'imports'), p(first, here, path) AS (SELECT s, t, [s, t] FROM e WHERE s < t
  UNION ALL SELECT first, e.t, list_append(path, e.t) FROM p JOIN e ON p.here = e.s WHERE len(path) < 5 AND e.t > first AND NOT list_contains(path, e.t))
SELECT DISTINCT array_to_string(list_sort(path), ',') AS members, CAST(len(path) AS INT) AS length, CASE WHEN len(path) > 4 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM p JOIN e ON e.s = p.here AND e.t = p.first""")
add("gr_cycles_all_edges", lambda v: gr.cycles(v.graph_edges, 3), f"""
WITH e AS ({E1}), two AS (SELECT DISTINCT a.s || ',' || a.t AS members, 2 AS length FROM e a JOIN e b ON a.t = b.s AND b.t = a.s WHERE a.s < a.t),
three AS (SELECT DISTINCT a.s || ',' || least(a.t, b.t) || ',' || greatest(a.t, b.t) AS members, 3 AS length FROM e a JOIN e b ON a.t = b.s JOIN e c ON b.t = c.s AND c.t = a.s WHERE a.s < a.t AND a.s < b.t AND a.t <> b.t)
SELECT members, length, 'HIGH' AS severity FROM two UNION ALL SELECT members, length, 'HIGH' FROM three""")
REACH = """WITH RECURSIVE e AS (SELECT DISTINCT source_id AS s, target_id AS t FROM graph_edges WHERE source_id <> target_id AND edge_type = 'imports'), r(a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b),
m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""
add("gr_components", lambda v: gr.strong_components(v.graph_edges.where("edge_type = 'imports'")), f"{REACH} SELECT id, component FROM m")
add("gr_cycles_whole", lambda v: gr.cyclic_components(v.graph_edges.where("edge_type = 'imports'")), f"{REACH} SELECT component, count(*) AS size, CASE WHEN count(*) > 4 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM m GROUP BY 1")
add("gr_domain_leak", lambda v: gr.domain_leaks(v.graph_edges), "WITH t AS (SELECT split_part(source_id, '.', 1) AS a, split_part(target_id, '.', 1) AS b FROM graph_edges) SELECT least(a, b) AS domain_a, greatest(a, b) AS domain_b, count(*) AS imports FROM t WHERE a <> b GROUP BY 1, 2 HAVING count(*) >= 3")
add("gr_layers", lambda v: gr.layer_violations(v.graph_edges, v.spark.createDataFrame(list(LAYERS), "name string, level int")), f"""
WITH l(name, level) AS (VALUES ('n1', 1), ('n2', 2), ('pkg3', 3)), o AS (SELECT id, min_by(name, level) AS name, min(level) AS level FROM ({NODES}) n JOIN l ON contains(id, name) GROUP BY 1)
SELECT a.name AS from_layer, b.name AS to_layer, count(*) AS violations FROM graph_edges e JOIN o a ON a.id = e.source_id JOIN o b ON b.id = e.target_id WHERE a.level > b.level GROUP BY 1, 2""")
add("gr_clusters", lambda v: gr.clusters(v.graph_edges), f"""
WITH RECURSIVE e AS ({E1}), p AS (SELECT a.s, a.t FROM e a JOIN e b ON a.s = b.t AND a.t = b.s), r(id, node) AS (SELECT DISTINCT s, s FROM p UNION SELECT r.id, p.t FROM r JOIN p ON r.node = p.s),
l AS (SELECT id, min(node) AS cluster FROM r GROUP BY 1), i AS (SELECT a.cluster, count(*) AS internal_edges FROM e JOIN l a ON a.id = e.s JOIN l b ON b.id = e.t WHERE a.cluster = b.cluster GROUP BY 1)
SELECT l.cluster, count(*) AS nodes, any_value(i.internal_edges) AS internal_edges FROM l JOIN i ON i.cluster = l.cluster GROUP BY 1 HAVING count(*) >= 3""")


def _index(v: Views):
    return gr.module_index(v.code_imports.select("repo_id", "path").distinct())


INDEX = """d AS (SELECT DISTINCT repo_id, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module, path FROM code_imports),
x AS (SELECT repo_id, module, path FROM d UNION ALL SELECT repo_id, stem, min(path) FROM (SELECT *, split_part(module, '.', -1) AS stem FROM d) s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.repo_id = s.repo_id AND d.module = s.stem) GROUP BY 1, 2)"""
add("gr_module_index", _index, f"WITH {INDEX} SELECT repo_id, module, path FROM x")
add("gr_import_edges", lambda v: gr.import_edges(v.code_imports, _index(v)), f"""
WITH {INDEX}, m AS (SELECT DISTINCT repo_id, path, module, string_split(module, '.') AS parts FROM code_imports),
k AS (SELECT repo_id, path, module, unnest(range(0, len(parts) + 1)) AS n, parts FROM m), h AS (SELECT k.repo_id, k.path AS source, k.module, k.n, x.path AS target FROM k JOIN x ON x.repo_id = k.repo_id AND x.module = CASE k.n WHEN 0 THEN parts[-1] ELSE array_to_string(parts[1:k.n], '.') END),
b AS (SELECT repo_id, source, module, arg_max(target, n) AS target FROM h GROUP BY 1, 2, 3) SELECT DISTINCT repo_id, source, target FROM b WHERE source <> target""")
add("gr_call_edges", lambda v: gr.call_edges(v.code_calls, v.code_functions), """
WITH c AS (SELECT DISTINCT repo_id, path, caller, regexp_replace(name, '^self\\.', '') AS called FROM code_calls), f AS (SELECT repo_id, path AS home, name, id FROM code_functions),
h AS (SELECT c.repo_id, c.path, caller, called, id, CASE WHEN f.name = called THEN 0 ELSE 2 END + CASE WHEN home = path THEN 0 ELSE 1 END AS r FROM c JOIN f ON f.repo_id = c.repo_id AND f.name = split_part(called, '.', -1))
SELECT DISTINCT repo_id, caller, id AS callee FROM (SELECT *, min(r) OVER (PARTITION BY repo_id, path, caller, called) AS least FROM h) WHERE r = least AND caller <> id""")
