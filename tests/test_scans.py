"""Scans on small files: one hit and one miss for each kind of rule, and the cases that the test tables lack."""

import pytest

from tallywright.operators import scan_rules, scans

LINES = "repo_id int, path string, line_no int, text string"


def lines(spark, content, path="a/m.py"):
    return spark.createDataFrame([(1, path, i + 1, t) for i, t in enumerate(content.split("\n"))], LINES)


def found(df):
    return sorted((r["rule_id"], r["line_no"], r["subtype"]) for r in df.collect())


@pytest.mark.parametrize("rule,hit,miss", [
    ("sc_secrets", 'API_KEY = "abc"', "api_key = key"), ("sc_sec_patterns", "x = eval(s)", "evaluate(s)"), ("sc_private_access", "a._b()", "self._b()"),
    ("sc_type_hints", "def f(a):", "def f(a) -> int:"), ("sc_docstrings", "def f(a):", "def _f(a):"), ("sc_null_risks", "d['k']", "d['k'] = 1"),
    ("sc_division", "a / b", "if b: a / b"), ("sc_timeouts", "requests.get(u)", "requests.get(u, timeout=1)"), ("sc_file_leak", "f = open(p)", "with open(p) as f:"),
    ("sc_unhandled", "f = open(p)", "with open(p) as f:"), ("sc_silent", "except:", "except ValueError:"), ("sc_float_eq", "x == 0.5", "isclose(x, 0.5) == 1.0"),
])
def test_line_rules(spark, rule, hit, miss):
    own = [r for r in scan_rules.LINE_RULES if r.rule == rule]
    assert found(scans.scan_lines(lines(spark, hit), own)) and not found(scans.scan_lines(lines(spark, miss), own))


@pytest.mark.parametrize("rule,hit,miss", [
    ("sc_impl_types", "def f() -> dict:", "def f() -> Dict:"), ("sc_no_error_handling", "d = json.load(f)", "try: json.load(f)"), ("sc_shared_mutable", "self.a = []", "self.a = [] or Queue()"),
    ("sc_threads", "threading.Thread(target=f)", "Threads(f)"), ("sc_env_usage", "os.getenv('A')", "getenv('A')"), ("sc_hardcoded", "timeout = 3", "timeout = limit"), ("sc_env_specific", "if ENV:", "ENV = 1"),
    ("sc_nplus1_line", "[db.query(x) for x in y]", "[f(x) for x in y]"), ("sc_untested_errors", "raise ValueError", "except:"), ("sc_conn_leak", "c = d.cursor()", "with d.cursor() as c:"), ("sc_thread_leak", "ThreadPoolExecutor(2)", "with ThreadPoolExecutor(2) as p:"),
    ("sc_critical_code", "charge_payment(x)", "charge(x)"),
])
def test_more_line_rules(spark, rule, hit, miss):
    own = [r for r in scan_rules.LINE_RULES if r.rule == rule]
    assert found(scans.scan_lines(lines(spark, hit), own)) and not found(scans.scan_lines(lines(spark, miss), own))


def test_paths_that_rules_leave_out(spark):
    own = [r for r in scan_rules.LINE_RULES if r.rule == "sc_critical_code"]
    for path in ("test_a.py", "x/test_a.py", "tests/a.py", "x/tests/y/a.py", "a.js"):
        assert not found(scans.scan_lines(lines(spark, "token", path), own))
    assert found(scans.scan_lines(lines(spark, "token", "contests/a_test.py"), own))
    js = [r for r in scan_rules.LINE_RULES if r.rule == "sc_sec_js"]
    assert found(scans.scan_lines(lines(spark, "a.innerHTML = b", "a.tsx"), js)) and not found(scans.scan_lines(lines(spark, "a.innerHTML = b", "a.py"), js))


@pytest.mark.parametrize("scan,hit,miss", [
    (scans.heavy_handlers, "@app.route('/')\nx = sorted(y)", "@app.route('/')\ndef f():\n  x = sorted(y)"), (scans.deadlocks, "a.acquire()\nb.acquire()\nwith my_lock:", "a.acquire()\nb.acquire()"),
    (scans.long_locks, "with lock:\n" + "x\n" * 22, "with lock:\n" + "x\n" * 19), (lambda d: scans.scan_near(d), "t = Thread(f); thread\nself.a.append(1)", "t = f\nself.a = 1"),
])
def test_scope_rules(spark, scan, hit, miss):
    assert found(scan(lines(spark, hit))) and not found(scan(lines(spark, miss)))


def test_file_rules(spark):
    rows = [("a.py", "for x in y:\n  await f(x)"), ("b.py", "await f(x)"), ("c.py", "self.cache = {}"), ("d.py", "self.cache = {}\nself.cache.clear()")]
    got = scans.scan_files(spark.createDataFrame([(1, *r) for r in rows], "repo_id int, path string, content string"), [r for r in scan_rules.FILE_RULES if r.rule in ("sc_await_loop", "sc_cache_growth")]).collect()
    assert sorted((r["rule_id"], r["path"], r["matches"]) for r in got) == [("sc_await_loop", "a.py", 1), ("sc_cache_growth", "c.py", 1)]


def test_javascript_comments_and_suites(spark):
    code = "/** doc */\nconst f = (a) => a\n * more\nconst g = (a) => a\nx\nconst h = function () {\nclass A {\n* doc\nclass B {\n/** doc */\nclass C {\nconst class_ = (class D {\nconst k = () => 1 // class E"
    own = [r for r in scan_rules.NEAR_RULES if r.rule == "sc_js_docs"]
    assert found(scans.scan_near(lines(spark, code, "a.js"), own)) == [("sc_js_docs", 6, "function"), ("sc_js_docs", 7, "class"), ("sc_js_docs", 9, "class"), ("sc_js_docs", 12, "class"), ("sc_js_docs", 13, "function")]
    suites = [r for r in scan_rules.LINE_RULES if r.rule == "sc_js_tests"]
    assert found(scans.scan_lines(lines(spark, "describe('a', () => { })\ndescribe('b', () => {", "a.ts"), suites)) == [("sc_js_tests", 1, "empty_suite")]


def test_registered_scans(spark):
    scans.register_scan("shouting", lambda d: scans.one_rule(d, d["text"].rlike("^[A-Z ]+$"), "own_shouting"))
    try:
        assert found(scans.run_scans(lines(spark, "HELLO\nimport left_pad"), ("shouting", "third_party"))) == [("own_shouting", 1, ""), ("sc_third_party", 2, "left_pad")]
        with pytest.raises(ValueError):
            scans.register_scan("shouting", scans.scan_lines)
    finally:
        del scans.SCANS["shouting"]


def test_first_subtype_only(spark):
    own = [r for r in scan_rules.LINE_RULES if r.rule == "sc_critical_code"]
    assert found(scans.scan_lines(lines(spark, "auth token password"), own)) == [("sc_critical_code", 1, "password")]


def test_neighbours(spark):
    got = found(scans.scan_near(lines(spark, "retry()\na\nb\nfor x in y:\n  db.query(x)\ntry:\n  n = int(s)\nn = int(s)\n.\n.\n.\nm = int(s)")))
    assert ("sc_retry", 1, "no_backoff") in got and ("sc_nplus1_window", 4, "") in got
    assert [g[1] for g in got if g[0] == "sc_unhandled"] == [12]
    assert found(scans.nested_loops(lines(spark, "for a in b:\n  for c in d:\n    for e in f:"))) == [("sc_nested_loops", 2, "2"), ("sc_nested_loops", 3, "3")]
    js = found(scans.scan_near(lines(spark, "it('a', f)\nexpect(x)\nclass A {\n/** doc */\nclass B {\ntest('b', f)", "a.js")))
    assert js == [("sc_js_docs", 3, "class"), ("sc_js_tests", 6, "no_assertion")]


def test_scopes(spark):
    assert [h[1] for h in found(scans.async_blocking(lines(spark, "async def f():\n  time.sleep(1)\ndef g():\n  time.sleep(1)")))] == [2]
    assert [h[1] for h in found(scans.risky_constructors(lines(spark, "def __init__(self):\n  x = open(p)\ndef g():\n  open(p)")))] == [2]
    methods = "\n".join(f"    def m{i}(self):\n        pass" for i in range(20))
    got = scans.god_classes(lines(spark, f"class A:\n{methods}\n    def _p(self): pass\nx = 1\nclass B:\n    def m(self): pass")).collect()
    assert [(r["class_name"], r["methods"], r["severity"]) for r in got] == [("A", 20, "MEDIUM")]
    assert found(scans.recursion(lines(spark, "def f(a):\n  return f(a - 1)\ndef g(b):\n  return 1"))) == [("sc_recursion", 1, "f")]
    assert [r["line_no"] for r in scans.incomplete_constructors(lines(spark, "class A:\n  self.xx = 1\n  self.yy(self.zz, self.ww)")).collect()] == [1]


def test_files(spark):
    files = spark.createDataFrame([(1, "README.md", "## Usage"), (1, "s.py", "DEBUG = True"), (1, "n.py", None)], "repo_id int, path string, content string")
    got = sorted((r["rule_id"], r["path"], r["subtype"]) for r in scans.scan_files(files).collect())
    assert got == [("sc_insecure", "s.py", "debug_mode"), *[("sc_readme", "README.md", w) for w in ("Contributing", "Features", "Installation")]]
    paths = spark.createDataFrame([(1, "a/x.py"), (1, "t/test_x.py"), (1, "a/y.py"), (2, "a/x.py")], "repo_id int, path string")
    assert sorted(map(tuple, scans.missing_tests(paths).collect())) == [(1, "a/y.py"), (2, "a/x.py")]


def test_empty_and_null(spark):
    none = spark.createDataFrame([], LINES)
    null = spark.createDataFrame([(None, "a.py", 1, None)], LINES)
    for df in (none, null):
        assert not found(scans.scan_lines(df)) and not found(scans.scan_near(df)) and not found(scans.nested_loops(df))


def test_literals_that_a_pattern_needs():
    import random
    import re

    from tallywright.operators import scan_rules
    from tallywright.operators.literals import literals

    assert literals(r"(?i)AKIA[0-9A-Z]{16}") == (("akia",), True)
    assert literals(r"\b(eval|open)\(") == (("eval", "open"), False)
    assert literals(r"x?") == literals(r"[ab]+") == literals(r"(foo|b)") == ((), False)
    assert literals(r"(?:open){2,}|close") == (("open", "close"), False)
    assert literals(r"(foo)*bar") == (("bar",), False)
    rng, patterns = random.Random(1), [p for r in scan_rules.LINE_RULES for p in (r.need, r.also, r.skip) if p]
    words = sorted({w for p in patterns for w in literals(p)[0]} | {" ", "(", ")", "=", "x", "1", ":", ".", '"'})
    for _ in range(3000):
        text = "".join(rng.choices(words, k=rng.randrange(1, 8)))
        for p in patterns:
            needed, folded = literals(p)
            if needed and re.search(p, text):
                assert any(n in (text.lower() if folded else text) for n in needed), (p, text)
    assert sum(bool(literals(p)[0]) for p in patterns) > 0.7 * len(patterns)


def test_god_classes_in_one_window(spark):
    text = ["def f():", "class A:", "    def m1(self):", "    def _p(self):", "  # note", "x = 1", "    def late(self):", "  class B(A):", "    def m2(self):", "", "    def m3(self):", "def top(self):", "    def m4(self):", "class C:"]
    lines = spark.createDataFrame([(1, "a.py", i, x) for i, x in enumerate(text, 1)], "repo_id int, path string, line_no int, text string")
    got = scans.god_classes(lines, 1)
    assert sorted((r["class_name"], r["line_no"], r["methods"]) for r in got.collect()) == [("A", 2, 1), ("B", 8, 3)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
