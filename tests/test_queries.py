"""Registered queries of the library against DuckDB on the smallest tables, and small fixtures."""

import datetime
import itertools
import os
import random

import duckdb
import pytest

from tallywright.operators import findings, graph, ledger
from tallywright.plans import catalog, graph_queries
from tallywright.sources import files

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "events", "part", "documents")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    if name in catalog.ORACLES:
        want = con.sql(catalog.ORACLES[name])
        names = list(want.columns)
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        got = sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
        assert len(rows) == len(got)
        for a, b in zip(rows, got, strict=True):
            assert all(x == y or abs(float(x) - float(y)) <= 1e-6 * max(1, abs(float(x))) for x, y in zip(a, b, strict=True) if x != y)


def test_golden_run(spark):
    rows = [(i, "r", i, t, "h") for i, t in enumerate(["RUN_CREATED", "ISSUE_DETECTED", "PLAN_APPROVED", "SAFETY_CHECK_PASSED", "FIX_APPLIED", "EDR_FINALIZED", "RUN_COMPLETED"])]
    cols = "id long, run_id string, sequence int, event_type string, actor_role string"
    full = spark.createDataFrame([(*r, None, "P", None, "s") for r in rows], cols + ", actor string, phase string, payload_ref string, summary string")
    runs = spark.createDataFrame([("r", "repo", "LEGACY", None, None, "COMPLETE")], "run_id string, repo_id string, run_policy_id string, started_at timestamp, ended_at timestamp, final_state string")
    assert ledger.violations(full, runs).collect() == []
    state = ledger.replay(full, runs).first()
    assert (state["event_count"], state["fixes_count"], state["plan_approved"], state["violations"]) == (7, 1, True, 0)
    gap = full.where("sequence <> 3")
    assert [tuple(r) for r in ledger.sequence_gaps(gap).collect()] == [("r", 3, 4)]
    assert ledger.no_terminal(full.where("sequence < 6")).first()["last_event"] == "EDR_FINALIZED"
    assert ledger.terminal_mismatch(full, runs.replace("COMPLETE", "REJECTED")).count() == 1


def test_lines(spark):
    df = spark.createDataFrame([("a", "x\r\ny\n\nz\n"), ("b", ""), ("c", "q")], "path string, content string")
    assert [tuple(r) for r in files.lines(df).orderBy("path", "line_no").collect()] == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, ""), ("a", 4, "z"), ("c", 1, "q")]


def test_webhooks(spark):
    pr = '{"action": "opened", "repository": {"full_name": "o/r"}, "pull_request": {"number": 3, "head": {"sha": "s"}}}'
    rows = [("1", "pull_request", pr), ("1", "pull_request", pr), ("2", "pull_request", pr.replace("opened", "closed")), ("3", "push", '{"after": "t", "repository": {"full_name": "o/r"}}'), ("4", "push", "{}")]
    got = files.webhooks(spark.createDataFrame(rows, "delivery_id string, event string, payload string")).collect()
    assert sorted(r["delivery_id"] for r in got) == ["1", "3"]


def test_impact_stops_before_the_last_edge(spark):
    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a")], "source_id string, target_id string").selectExpr("*", "'calls' AS edge_type")
    got = graph.impact(edges, spark.createDataFrame([("a",)], "id string"), 3).collect()
    assert sorted((r["id"], r["distance"]) for r in got) == [("b", 1), ("c", 2)]


def test_impact_against_brute_force(spark):
    import random

    draw = random.Random(3)
    pairs = [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(90)] + [(f"x{i}", "hub") for i in range(90)] + [("hub", f"y{i}") for i in range(90)] + [("y1", "hub"), (None, "hub"), ("hub", None)]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    into = {}
    for a, b in pairs:
        into.setdefault(b, set()).add(a)
    nodes = sorted({n for p in pairs for n in p if n})

    def brute(depth):
        for seed in nodes:
            seen, front = {seed}, {seed}
            for distance in range(1, depth):
                front = {a for b in front for a in into.get(b, ()) if a} - seen
                seen |= front
                yield from ((seed, n, distance) for n in front)

    seeds = spark.createDataFrame([(n,) for n in [*nodes, nodes[0], None]], "id string")
    for depth, cell in ((1, 4), (2, 4096), (3, 4), (4, 16), (5, 4096)):
        assert sorted(map(tuple, graph.impact(edges, seeds, depth, cell).collect())) == sorted(brute(depth))


def test_impact_of_a_hub(spark):
    edges = spark.range(100_000).selectExpr("'x' || id AS source_id", "'hub' AS target_id").union(spark.sql("SELECT 'hub', 'y' || id FROM range(70)"))
    got = graph.impact(edges, graph.nodes_of(edges)).groupBy("distance").count().collect()
    assert {r["distance"]: r["count"] for r in got} == {1: 100_070, 2: 7_000_000}


def shuffled_rows(spark):
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_impact_sends_lists_not_pairs(spark):
    edges = spark.sql("SELECT 'm' || id % 100 AS source_id, format_string('s%04d', id) AS target_id FROM range(2000) UNION ALL SELECT 'x' || id, 'm' || id % 100 FROM range(30000)")
    before = shuffled_rows(spark)
    got = graph.impact(edges, graph.nodes_of(edges)).groupBy("distance").count().collect()
    assert {r["distance"]: r["count"] for r in got} == {1: 32_000, 2: 600_000}
    assert shuffled_rows(spark) - before < 400_000


def shuffled_bytes(spark):
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_impact_sends_few_bytes_for_each_row(spark):
    edges = spark.sql("SELECT 'm' || id % 100 AS source_id, format_string('s%04d', id) AS target_id FROM range(2000) UNION ALL SELECT 'pkg' || id % 12 || '.n' || id, 'm' || xxhash64(id) % 100 FROM range(60000)")
    before = shuffled_bytes(spark)
    assert graph.impact(edges, graph.nodes_of(edges)).where("distance = 2").count() > 500_000
    assert shuffled_bytes(spark) - before < 9_000_000


def test_packed_ids():
    for ids in ([], [b""], [b"", b""], [b"a", "é".encode()], [b"\0", b"\1", b"\1\1", b"\0\1\2", b"\1\2\0", b"x\1"]):
        assert graph.unpacked(graph.packed(ids)) == ids


def test_layers_in_the_plan_and_by_a_join(spark, monkeypatch):
    rows = [("core.a", "ui.b"), ("ui.b", "core.a"), ("ui.b", "core.a"), ("ui.core", "data.x"), ("none", "ui.b"), (None, "ui.b"), ("data.x", "core.a")]
    edges = spark.createDataFrame(rows, "source_id string, target_id string")
    layers = spark.createDataFrame([("ui", 2), ("core", 1), ("data", 1), (None, 0), ("data", 3)], "name string, level int")
    want = [("ui", "core", 2)]
    assert sorted(map(tuple, graph.layer_violations(edges, layers).collect())) == want
    monkeypatch.setattr(graph, "LAYERS", 2)
    assert sorted(map(tuple, graph.layer_violations(edges, layers).collect())) == want
    assert graph.layer_violations(edges, layers.where("false")).collect() == []


def test_cycles(spark):
    edges = spark.createDataFrame([(a, b) for a, b in zip("abcde", "bcdea", strict=True)] + [("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("q", "q")], "source_id string, target_id string")
    got = sorted((r["members"], r["length"], r["severity"]) for r in graph.cycles(edges).collect())
    assert got == [("a,b,c,d,e", 5, "CRITICAL"), ("a,c,d,e", 4, "HIGH"), ("x,y", 2, "HIGH")]
    assert graph.cycles(edges.where("false")).collect() == []


def test_strong_components(spark):
    ring = [(f"m{i:03d}", f"m{(i + 1) % 200:03d}") for i in range(200)]
    tail = [("m000", "t0"), ("t0", "t1"), ("h0", "m005"), ("t1", "u0"), ("u0", "u1"), ("u1", "u0"), ("a", "a"), ("u0", "b"), ("b", "c"), ("c", "d"), ("d", "b")]
    edges = spark.createDataFrame(ring + tail, "source_id string, target_id string")
    assert sorted(map(tuple, graph.cyclic_components(edges).collect())) == [("b", 3, "HIGH"), ("m000", 200, "CRITICAL"), ("u0", 2, "HIGH")]
    assert graph.strong_components(edges.where("false")).collect() == [] and graph.strong_components(edges.where("source_id = 't0'")).collect() == []


def test_whole_payloads_are_read_once(spark):
    plan = catalog.QUERIES["led_finding_event_full"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("get_json_object(") == 1


def test_conflicts(spark):
    rows = [(1, 1, "same", ["a"]), (2, 1, "same", ["a"]), (3, 1, "same", ["a"]), (4, 2, "same", ["a"]), (5, 1, "other", ["a"]), (6, 2, "x" * 50 + "1", ["b"]), (7, 2, "x" * 50 + "2", ["b"])]
    df = spark.createDataFrame([(i, r, s, [(p, None, None) for p in ps]) for i, r, s, ps in rows], "id long, repo_id long, problem_statement string, affected_files array<struct<path: string, line_range: string, severity: string>>")
    assert sorted(map(tuple, findings.conflicts(df).collect())) == [(1, 2, 2), (2, 2, 1), (3, 2, 1), (6, 1, 7), (7, 1, 6)]
    assert sorted((r["id"], r["conflicts"]) for r in findings.conflict_groups(df).collect()) == [(1, [2, 3]), (2, [1, 3]), (3, [1, 2]), (6, [7]), (7, [6])]


def test_call_edges(spark):
    calls = spark.createDataFrame([(1, "f", "f::x", "self.y"), (1, "f", "f::x", "m.z"), (1, "g", "g::q", "q"), (2, "f", "f::x", "z")], "repo_id int, path string, caller string, name string")
    functions = spark.createDataFrame([(1, "f", "y", "f::y"), (1, "g", "y", "g::y"), (1, "g", "z", "g::z"), (1, "g", "q", "g::q"), (2, "h", "z", "h::z")], "repo_id int, path string, name string, id string")
    assert sorted(map(tuple, graph.call_edges(calls, functions).collect())) == [(1, "f::x", "f::y"), (1, "f::x", "g::z"), (2, "f::x", "h::z")]


def test_modules_of_two_repositories(spark):
    files_ = spark.createDataFrame([(1, "a/x.py"), (2, "a/x.py"), (2, "b/x.py"), (1, "m.py")], "repo_id int, path string")
    index = graph.module_index(files_)
    assert sorted(map(tuple, index.collect())) == [(1, "a.x", "a/x.py"), (1, "m", "m.py"), (1, "x", "a/x.py"), (2, "a.x", "a/x.py"), (2, "b.x", "b/x.py"), (2, "x", "a/x.py")]
    imports = spark.createDataFrame([(1, "m.py", "b.x"), (2, "a/x.py", "b.x.Thing"), (2, "a/x.py", "m")], "repo_id int, path string, module string")
    assert sorted(map(tuple, graph.import_edges(imports, index).collect())) == [(1, "m.py", "a/x.py"), (2, "a/x.py", "b/x.py")]


@pytest.mark.parametrize("cell", [3, 4096])
def test_cycles_against_brute_force(spark, cell):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(60)}
    edges = spark.createDataFrame(sorted(pairs) + [("n1", "n2"), ("x", "n1"), (None, "n1")], "source_id string, target_id string")
    nodes = sorted({n for p in pairs for n in p})
    for longest in (2, 3, 4):
        want = {(",".join(sorted(p)), k) for k in range(2, longest + 1) for p in itertools.permutations(nodes, k) if all((a, b) in pairs for a, b in zip(p, (*p[1:], p[0]), strict=True))}
        assert sorted((r["members"], r["length"]) for r in graph.cycles(edges, longest, cell=cell).collect()) == sorted(want)


def test_cycles_send_no_row_for_each_path(spark):
    # all paths of three nodes in a graph between two halves are some hundred thousand; no cycle of three closes one
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.sql("SELECT 'n' || a.id AS source_id, 'n' || b.id AS target_id FROM range(120) a JOIN range(120) b ON (a.id + b.id) % 2 = 1")
        before = shuffled_rows(spark)
        assert graph.cycles(edges, 3).where("length = 3").count() == 0
        assert shuffled_rows(spark) - before < 100_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_code_files_take_no_folder_each(spark, tmp_path):
    path = str(tmp_path / "code")
    rows = spark.sql("SELECT id % 3 AS folder, 'n' || id || '_py' AS name, CASE WHEN id <> 7 THEN 'é\\n' || id END AS content FROM range(300)").repartition(8)
    for _ in range(2):  # a task that runs again puts the same files in place
        files.write_files(rows, path)
        got = {r["name"]: r["content"] for r in files.code_files(spark, path, ("txt",)).select(files.file_name().alias("name"), "content").collect()}
        assert got == {f"n{i}_py": (f"é\n{i}" if i != 7 else "") + "\n" for i in range(300)}
    assert sum(len(files_) for _, _, files_ in os.walk(path)) == 300
    assert sum(1 for _ in os.walk(path)) == 4
    rows.write.partitionBy("folder", "name").text(str(tmp_path / "spark"))  # the form that Spark writes on other file systems
    names = files.code_files(spark, str(tmp_path / "spark"), ("txt",)).select(files.file_name().alias("name")).collect()
    assert sorted(r["name"] for r in names) == sorted(got)


def test_src_code_files_takes_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_queries, "scratch_dir", lambda spark: str(tmp_path / "code"))
    n = catalog.QUERIES["src_code_files"](spark, SF).count()
    assert n > 10 and sum(1 for _ in os.walk(tmp_path / "code")) <= 1 + n // 2


def test_code_files_in_other_encodings(spark, tmp_path):
    for name, raw in (("a.py", "x = 'é'\n".encode("latin-1")), ("b.py", b"\xff\xfe\x00y = 1"), ("c.py", "z = '\u00e9'".encode()), ("d.txt", b"no"), ("node_modules/e.py", b"no"), ("sub/f.js", b"f")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in files.code_files(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = ''\n", "b.py": "\x00y = 1", "c.py": "z = '\u00e9'", "f.js": "f"}
