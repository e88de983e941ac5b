"""Facts of files that do not parse, that are empty or null, and of nested functions."""

import ast
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywright.operators import graph
from tallywright.operators import scores as sc
from tallywright.operators import structure as st
from tallywright.sources.fact_store import FactStore


def test_facts(spark):
    code = "def a(x):\n    if x and y:\n        def b():\n            while x:\n                pass\n"
    rows = [(1, "ok.py", code), (1, "bad.py", "def ("), (1, "null.py", None), (1, "empty.py", "")]
    f = st.facts(spark.createDataFrame(rows, "repo_id int, path string, content string"))
    assert {r["path"] for r in f.collect()} == {"ok.py", "null.py", "empty.py"}
    got = {r["name"]: r["complexity"] for r in st.cyclomatic(f, 0).collect()}
    assert got == {"a": 5, "b": 2}
    none = st.facts(spark.createDataFrame([], "repo_id int, path string, content string"))
    assert none.count() == 0 and st.code_nodes(none).count() == 0


def _rows(spark, *files):
    return spark.createDataFrame([(1, *f) for f in files], "repo_id int, path string, content string")


def test_loops_sections_and_names(spark):
    code = (
        "from a.b import c\nimport d\n\nclass K(P.Q):\n    def m(self, x):\n        '''Does it at length.'''\n        for i in x:\n            for j in i:\n"
        "                self.n -= 1\n                t = c.u + c.u + c.u + c.u\n                get(t)\n        return x\n    def _p(self):\n        return [1 for q in c.v]\n"
    )
    f = st.facts(_rows(spark, ("k.py", code), ("bad.py", "def (")))
    smells = sorted((r["line"], r["smell"], r["detail"]) for r in st.loop_smells(f).collect())
    assert smells == [(7, "query", None), (7, "repeated_attribute", "c.u"), (8, "query", None), (8, "repeated_attribute", "c.u")]
    problems = sorted((r["line"], r["problem"], r["severity"]) for r in st.doc_issues(f).collect())
    assert problems == [(1, "no_docstring", "MEDIUM"), (4, "no_docstring", "HIGH"), (5, "no_parameter_section", "MEDIUM"), (5, "no_return_section", "MEDIUM")]
    assert [(r["name"], r["names"]) for r in st.couplings(f, 0).collect()] == [("K", 8)]
    assert [(r["name"], r["root"], r["accesses"]) for r in st.feature_envy(f, 3).collect()] == [("m", "c", 4)]
    edges = {(r["source_id"], r["target_id"], r["edge_type"]) for r in st.structural_edges(f).collect()}
    assert edges == {("k.py", "k.py::K", "defines"), ("k.py::K", "P.Q", "inherits"), ("k.py::K", "k.py::K.m", "contains"), ("k.py::K", "k.py::K._p", "contains")}
    checks = st.module_checks(f, _rows(spark, ("k.py", code)), code_lines=12, imports=1, from_imports=0, classes=1).collect()
    assert sorted(r["problem"] for r in checks) == ["from_imports", "imports", "lines"] and {r["code_lines"] for r in checks} == {13}


def test_scores_of_nothing_and_of_much(spark):
    rows = [(1, "critical", "security")] * 6 + [(2, "high", "performance"), (2, "medium", "architecture"), (3, None, "security")]
    issues = spark.createDataFrame(rows, "run_id int, severity string, family string")
    parts = [sc.family_scores(issues, "run_id", family) for family in sc.WEIGHTS]
    scores = parts[0].union(parts[1]).union(parts[2])
    assert {(r["run_id"], r["family"]): r["score"] for r in scores.collect()} == {(1, "security"): 0, (2, "performance"): 85, (2, "architecture"): 94, (3, "security"): 100}
    got = {r["run_id"]: (r["overall"], r["debt_hours"], r["risk"]) for r in sc.overall(scores, issues, "run_id").collect()}
    assert got == {1: (0, 24, 100), 2: (90, 3, 15), 3: (100, 0, 0)}
    ranks = {r["severity"]: r["severity_rank"] for r in sc.aggregate({"a": issues.drop("family")}).collect()}
    assert ranks == {"critical": 0, "high": 1, "medium": 2, None: 999}
    none = issues.where("false")
    assert sc.overall(sc.family_scores(none, "run_id", "security"), none, "run_id").count() == 0


def test_depth_of_loops_and_bytes_that_are_not_text(spark):
    code = "".join(f"{'    ' * i}for x{i} in y:\n" for i in range(5)) + "    " * 5 + "pass\n" + "async def a():\n    async for x in y:\n        for z in x:\n            pass\n"
    rows = [(1, "deep.py", code.encode()), (2, "deep.py", b"while x:\n    while '\xe9':\n        pass\n")]
    f = st.facts(spark.createDataFrame(rows, "repo_id int, path string, content binary"))
    got = sorted((r["repo_id"], r["line"], r["depth"], r["severity"]) for r in st.loop_nesting(f).collect())
    assert got == [(1, 1, 5, "HIGH"), (1, 2, 4, "HIGH"), (1, 3, 3, "HIGH"), (1, 4, 2, "MEDIUM"), (2, 1, 2, "MEDIUM")]


def test_nodes_of_two_repositories(spark):
    rows = [(1, "a.py", "class A:\n    pass\n"), (2, "a.py", "def A():\n    pass\n")]
    f = st.facts(spark.createDataFrame(rows, "repo_id int, path string, content string"))
    assert sorted((r["repo_id"], r["id"], r["node_type"]) for r in st.code_nodes(f).collect()) == [(1, "a.py", "file"), (1, "a.py::A", "class"), (2, "a.py", "file"), (2, "a.py::A", "function")]
    assert sorted(tuple(r) for r in st.structural_edges(f).collect()) == [(1, "a.py", "a.py::A", "defines"), (2, "a.py", "a.py::A", "defines")]


def test_last_node_of_an_id(spark):
    f = st.facts(_rows(spark, ("a.py", "def f():\n    pass\n\nclass f:\n    pass\n")))
    assert {(r["id"], r["node_type"]) for r in st.code_nodes(f).collect()} == {("a.py", "file"), ("a.py::f", "class")}


def test_scores_of_tests_with_smells_and_missing_files(spark):
    f = st.facts(_rows(spark, ("test_a.py", "def test_a():\n    assert 1\n")))
    smells = spark.createDataFrame([(1,)] * 9, "repo_id int")
    missing = spark.createDataFrame([(1, "b.py"), (1, "c.py"), (2, "d.py")], "repo_id int, path string")
    score = lambda **more: sc.test_scores(f, **more).first()["score"]
    assert (score(), score(smells=smells), score(missing=missing), score(smells=smells, missing=missing)) == (100, 80, 96, 76)


def test_clusters(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("d", "c"), ("c", "d"), ("e", "a"), ("a", "c"), ("x", "y"), ("y", "x"), ("a", "a")]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    assert [tuple(r) for r in graph.clusters(edges).select("cluster", "nodes", "internal_edges").collect()] == [("a", 4, 7)]
    assert graph.clusters(edges.where("false")).count() == 0


def test_stored_facts(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "f"), buckets=4)
    assert store.read().count() == 0
    code = "class A:\n    def m(self):\n        for x in y:\n            for z in x:\n                pass\n"
    files = [(1, "a.py", code), (1, "copy.py", code), (2, "a.py", code + "\nassert a\n"), (1, "bad.py", "def ("), (1, "null.py", None), (1, "empty.py", ""), (1, None, "b = c.d\n"), (3, "latin.py", "x = 1\n")]
    given = lambda rows: spark.createDataFrame(rows, "repo_id int, path string, content string")
    texts = lambda: {r["version"]: r["count"] for r in store.hashes().groupBy("version").count().collect()}
    same = lambda rows: sorted(map(str, store.read().collect())) == sorted(map(str, st.facts(given(rows)).collect()))
    store.add(1, given(files))
    assert texts() == {1: 6} and same(files)
    store.add(2, given(files))  # nothing is parsed again
    assert texts() == {1: 6} and same(files) and not os.path.exists(f"{store.path}/facts/version=2")
    changed = [(1, "a.py", code + "b = 1\n"), (4, "moved.py", code), *files[1:]]
    store.add(3, given(changed[:2]))
    store.add(3, given(changed[:2]))  # the same version again
    assert texts() == {1: 6, 3: 1} and same(changed)
    store.remove(4, spark.createDataFrame([(1, "copy.py"), (9, "none.py")], "repo_id int, path string"))
    left = [r for r in changed if r[:2] != (1, "copy.py")]
    assert texts() == {1: 6, 3: 1} and same(left)
    store.add(5, given(files[1:2]))  # back again, its text is known
    assert texts() == {1: 6, 3: 1} and same(changed)
    assert sorted(map(str, st.loop_nesting(store.read()).collect())) == sorted(map(str, st.loop_nesting(st.facts(given(changed))).collect()))
    plan = st._kind(store.read(), "FunctionDef").select("path", "name")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("FileScan") if "facts" in x)
    assert "kind" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "doc" not in scan.split("ReadSchema")[1]


def test_a_version_of_facts_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    store = FactStore(spark, str(tmp_path / "f"), buckets=2)
    store.add(1, _rows(spark, ("a.py", "x = 1\n")))
    before = sorted(map(str, store.read().collect()))
    with monkeypatch.context() as m:
        m.setattr(store.files, "merge", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.add(2, _rows(spark, ("a.py", "y = z.q\n")))
    assert sorted(map(str, store.read().collect())) == before
    store.add(2, _rows(spark, ("a.py", "y = z.q\n")))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, st.facts(_rows(spark, ("a.py", "y = z.q\n"))).collect()))


def test_facts_of_some_kinds_of_equal_texts(spark):
    code = "import a\nclass A(B):\n    def m(self, x: int):\n        '''Doc.'''\n        for y in x:\n            assert y and x.z\n        return [b for b in x]\n"
    rows = [(i, f"{i}.py", code if i % 3 else f"{code}c = {i}\n") for i in range(60)] + [(61, "bad.py", "def ("), (62, "null.py", None)]
    files = spark.createDataFrame(rows, "repo_id int, path string, content string")
    whole = st.facts(files)
    assert {r["n"] for r in whole.where("repo_id < 60").groupBy("repo_id").agg(F.sum(F.when(F.col("kind") == "Name", 0).otherwise(1)).alias("n")).collect()} == {13}
    for name, (kinds, _) in st.NEEDS.items():
        metric = getattr(st, name)
        given = (lambda f, metric=metric, name=name: metric(f, files, code_lines=1) if name == "module_checks" else metric(f))
        some = st.facts(files, name)
        assert kinds is None or {r["kind"] for r in some.select("kind").distinct().collect()} <= set(kinds)
        drop = lambda df: df.drop("class_id")  # noqa: E731  numbers of nodes differ where only statements are walked
        assert sorted(map(str, drop(given(some)).collect())) == sorted(map(str, drop(given(whole)).collect())), name


def _facts_by_pieces(parser, text):
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    places = parser.places(text)
    taken = [(c.split()[0], kinds[c.split()[1]]) for c in st.NODE.split(", ")]
    return list(zip(*(c.to_pylist() for c in st._columns(places, taken)[1]), strict=True)) if places else []


def test_pieces_give_the_facts_of_whole_texts():
    texts = [
        "", "# c\n'doc a1'\nx = 1\n", "class A:\n    'd1 {x}'\n    x = 1\n", "class A:\n    x1 = '''\nfoo\n'''\n    y = 2\n", "class A:\n  x\n y\n", "class A:\n    x = 1\n\fy = 1\n", "x = '''\ny = 1\n'''\nz = 1\n",
        "@d1\n@d2\nclass A1(B2, c.D3):\n    @p\n    def f1(self): return 1.e5\n    if a:\n        b\n    else:\n        c\n", "b'm12'\n", "'a''m12'\n", "x = 1 \\\ny = 2\n", "x = f'{a1!r} {a1=} {b:x2}'\n", "x = 0b12\n",
        "class A1(B2):\n\n    # c\n    def f2(self):\n        '''Doc.\n\n        {a} m1\n        '''\n# left\n        for x1 in y1:\n            while z: pass\n\n\ndef g(): pass\n", "class C:\n    '''tab\there m1'''\n    z9 = 1\n",
        "try:\n    a\nexcept E1 as e2:\n    b\nfinally:\n    c\n", "class A1:\n    class B2:\n        def f3(self):\n            self.x4 += 1\n        y5 = [q6 for q6 in z7]\n", "class A[T1](B):\n    x: T1\n", "\u00e91m2 = 1\n", "class A:\n    x\n)\n",
        "from __future__ import barry_as_FLUFL\na <> b\n", "import a.b2\r\nclass A(B):\r\n    x = c3\r\n", "class A:\n    pass\n  # odd\n    c = 1\n", "x = 1\0\n", "if x:\n    a1\nelif y:\n    b\nelse_2 = 1\n",
    ]
    for kinds in (None, frozenset(("FunctionDef", "ClassDef", "Module")), frozenset(("Base", "Attribute", "Name"))):
        parser = st._Parser(kinds)
        for text in texts * 2:
            try:
                whole = st._facts_of(ast.parse(text), kinds)[0]
            except (SyntaxError, ValueError):
                whole = []
            assert _facts_by_pieces(parser, text) == whole, text


def test_statements_that_differ_in_names_are_parsed_once(monkeypatch):
    parse, calls = ast.parse, []
    monkeypatch.setattr(st.ast, "parse", lambda text: calls.append(text) or parse(text))
    parser = st._Parser(None)
    texts = ["class C%d(Base):\n" % i + "".join(f"    def m{i}_{j}(self):\n        return self.k{j}\n" for j in range(1 + i % 7)) for i in range(200)]
    got = [_facts_by_pieces(parser, t) for t in texts]
    assert len(calls) < 10
    assert got == [st._facts_of(parse(t))[0] for t in texts]
