"""Structural metrics of Python code: one job extracts facts, all else is relational.

A fact is a row for a syntax node: node_id and parent_id (numbers within the file), funcs, classes, loops (enclosing ones, outermost
first), class_id (nearest class), kind, name, line, end_line, n (parameters, bases, or values of a condition), flag (has a docstring,
a timeout, or a value that is returned), doc (docstring).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

NODE = "node_id int, parent_id int, funcs array<int>, classes array<int>, loops array<int>, class_id int, kind string, name string, line int, end_line int, n int, flag boolean, doc string"
FACT = f"repo_id long, path string, {NODE}"
KEY = ("repo_id", "path")
#: Names of calls that are taken for queries. Fixed values.
QUERY_CALLS = ("get", "filter", "all", "select", "query", "fetch")
#: Headings of docstring sections. Fixed values.
PARAMETER_HEADS = ("Args:", "Arguments:", "Parameters:", "Params:")
RETURN_HEADS = ("Returns:", "Return:", "Yields:", "Yield:")
RAISE_HEADS = ("Raises:", "Raise:", "Throws:", "Throw:")
_FUNCTION, _LOOP = (ast.FunctionDef, ast.AsyncFunctionDef), (ast.For, ast.While, ast.AsyncFor)
_KEPT = (
    *_FUNCTION, *_LOOP, ast.ClassDef, ast.Module, ast.Call, ast.Attribute, ast.Name, ast.BoolOp, ast.If, ast.ExceptHandler, ast.Assert, ast.ListComp,
    ast.AugAssign, ast.Import, ast.ImportFrom, ast.Return, ast.Raise,
)
_KIND = {t: "FunctionDef" if t in _FUNCTION else t.__name__ for t in _KEPT}
#: Kinds that stand in expressions; where none of them is asked for, only statements are walked.
_IN_EXPRESSIONS = frozenset(("Call", "Attribute", "Name", "BoolOp", "ListComp"))
_STATEMENTS = ("body", "orelse", "handlers", "finalbody", "cases")
#: Fields that hold no node below which a kept one may stand.
_BARE = frozenset(("ctx", "op", "ops", "id", "attr", "names", "module", "level", "type_comment", "type_ignores", "kind", "conversion", "simple", "is_async", "asname"))
#: The kinds (None: all) and columns of facts that each metric reads, for facts().
NEEDS = {
    "kind_counts": (None, ()),
    "class_sizes": (("FunctionDef", "ClassDef"), ("node_id", "parent_id", "name", "line", "end_line")),
    "instance_variables": (("Attribute",), ("class_id", "name")),
    "multiple_inheritance": (("Base",), ("class_id", "name")),
    "function_sizes": (("FunctionDef",), ("name", "line", "end_line", "n")),
    "cyclomatic": (("FunctionDef", "If", "While", "For", "ExceptHandler", "BoolOp"), ("node_id", "funcs", "name", "line", "n")),
    "loop_nesting": (("For", "While"), ("node_id", "parent_id", "line")),
    "calls_and_asserts": (("Assert", "Call"), ("name", "line", "flag")),
    "doc_coverage": (("FunctionDef", "ClassDef", "Module"), ("flag",)),
    "test_quality": (("FunctionDef", "Assert", "Call"), ("node_id", "funcs", "name", "line", "end_line")),
    "code_nodes": (("FunctionDef", "ClassDef", "Module"), ("node_id", "parent_id", "name", "line")),
    "structural_edges": (("FunctionDef", "ClassDef", "Base"), ("node_id", "parent_id", "name")),
    "couplings": (("ClassDef", "Name"), ("node_id", "classes", "name", "line")),
    "feature_envy": (("FunctionDef", "Attribute"), ("node_id", "funcs", "name", "line")),
    "module_checks": (("Module", "Import", "ImportFrom", "ClassDef"), ("name",)),
    "loop_smells": (("For", "While", "ListComp", "AugAssign", "Attribute", "Call"), ("node_id", "loops", "name", "line")),
    "doc_issues": (("FunctionDef", "ClassDef", "Module", "Param", "Return", "Raise"), ("node_id", "parent_id", "funcs", "name", "line", "flag", "doc")),
}


def _name(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_name(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


class _Fields(dict):
    """Fields of each class of nodes that are walked, last first."""

    def __init__(self, statements: bool):
        self.statements = statements

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = out = tuple(f for f in reversed(kind._fields) if (f in _STATEMENTS if self.statements else f not in _BARE))
        return out


_FIELDS, _STATEMENT_FIELDS = _Fields(False), _Fields(True)
#: Values and nodes below which no kept node stands, and which are none.
_LEAVES = frozenset((type(None), str, int, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal))


def _facts_of(tree: ast.AST, kinds: frozenset[str] | None = None) -> tuple[list[tuple], int]:
    """The facts (of some kinds; None: all) of a tree, and how many numbers its nodes take."""
    todo = [(tree, None, [], [], [])]
    rows, number, below = [], 0, _STATEMENT_FIELDS if kinds is not None and not kinds & _IN_EXPRESSIONS else _FIELDS
    leaves = _LEAVES if kinds is None or "Name" in kinds else _LEAVES | {ast.Name}
    while todo:
        node, parent, funcs, classes, loops = todo.pop()
        me, number, t = number, number + 1, type(node)
        kind = _KIND.get(t)
        if kind == "FunctionDef" or kind == "ClassDef" or kind == "Module":
            doc = ast.get_docstring(node)
            parts = [("Param", a.arg) for a in node.args.args] if kind == "FunctionDef" else [("Base", _name(b)) for b in node.bases] if kind == "ClassDef" else []
            own = me if kind == "ClassDef" else classes[-1] if classes else None
            for part_kind, part in parts:
                if kinds is None or part_kind in kinds:
                    rows.append((number, me, funcs, classes, loops, own, part_kind, part, node.lineno, node.lineno, 0, False, None))
                number += 1
            if kinds is None or kind in kinds:
                rows.append((me, parent, funcs, classes, loops, classes[-1] if classes else None, kind, getattr(node, "name", None), getattr(node, "lineno", 1), getattr(node, "end_lineno", 1), len(parts), doc is not None, doc))
        elif kind is not None and (kinds is None or kind in kinds):
            name, n, flag = None, 0, False
            if kind == "Attribute" or kind == "Name":
                name = _name(node)
            elif kind == "Call":
                name, flag = _name(node.func), any(k.arg == "timeout" for k in node.keywords)
            elif kind == "ImportFrom":
                name = node.module
            elif kind == "AugAssign":
                name = type(node.op).__name__
            elif kind == "ExceptHandler":
                name = node.name
            elif kind == "Return":
                flag = node.value is not None
            elif kind == "BoolOp":
                n = len(node.values)
            rows.append((me, parent, funcs, classes, loops, classes[-1] if classes else None, kind, name, node.lineno, node.end_lineno, n, flag, None))
        if t in _FUNCTION:
            funcs = [*funcs, me]
        elif t is ast.ClassDef:
            classes = [*classes, me]
        elif t in _LOOP:
            loops = [*loops, me]
        for field in below[t]:
            value = getattr(node, field, None)
            if value.__class__ is list:
                for x in reversed(value):
                    if x.__class__ not in leaves:
                        todo.append((x, me, funcs, classes, loops))
            elif value.__class__ not in leaves:
                todo.append((value, me, funcs, classes, loops))
    return rows, number


#: Facts of a batch that goes to Spark, about; and those (with a hundredth of the texts' bytes) of pieces that are held to be given again.
_ROWS, _HELD = 20_000, 50_000
#: Columns of facts, where they stand in a row; all kinds.
_AT = {c.split()[0]: i for i, c in enumerate(NODE.split(", "))}
_KINDS = sorted({*_KIND.values(), "Param", "Base"})
#: Where a statement at the left edge starts; a class whose body starts in the next line; a name with a digit, and its mark in a skeleton,
#: by a letter that no ASCII text has.
_EDGE = r"\n%s(?=[^\s#)\]}])"
_STARTS, _CLASS = {0: re.compile(_EDGE % "")}, re.compile(r"(class \w+(?:\([\w., ]*\))?:) *\n( +)(?=[^\s#])")
_NUMBERED, _MARK = re.compile(r"(?<!\w)([A-Za-z_]+[0-9]\w*)"), re.compile("\u0180([0-9]+)\u0180")
_GOES_ON = ("else", "elif", "except", "finally")


class _Piece:
    """Facts of a piece of code, with numbers and lines of its own: number 0 is what it stands in (module or class), which is no part of
    it. Names are marks, which `marks` (row, column, format) turn into those of a text."""

    def __init__(self, rows: list[tuple], numbers: int, host: ast.Module | ast.ClassDef, shift: int):
        self.size, self.numbers, self.last = len(rows), numbers, host.body[-1].end_lineno - shift if host.body else 0
        self.doc = _form(ast.get_docstring(host))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_AT)
        ints = lambda c, none=-1: np.array([none if x is None else x for x in cols[_AT[c]]], np.int64)
        self.cols = {c: ints(c) for c in ("node_id", "parent_id", "class_id", "n")} | {c: ints(c) - shift for c in ("line", "end_line")}
        self.cols |= {"flag": np.array(cols[_AT["flag"]], bool), "kind": np.array([_KINDS.index(k) for k in cols[_AT["kind"]]], np.int64)}
        for c in ("funcs", "classes", "loops"):
            self.cols[c], self.cols[c + "_size"] = np.array(list(chain.from_iterable(cols[_AT[c]])), np.int64), np.array([len(x) for x in cols[_AT[c]]], np.int64)
        self.texts = {c: list(cols[_AT[c]]) for c in ("name", "doc")}
        self.marks = [(i, c, _form(x)) for c, texts in self.texts.items() for i, x in enumerate(texts) if x is not None and _MARK.search(x)]
        self.head = next((i for i, k in enumerate(cols[_AT["kind"]]) if k in ("ClassDef", "Module")), None)


def _form(text: str | None) -> str | None:
    """A text with marks as a format of the names."""
    return text if text is None else _MARK.sub(r"{\1}", text.replace("{", "{{").replace("}", "}}"))


def _skeleton(text: str) -> tuple[str, tuple[str, ...]]:
    """The text with marks for its names that hold digits, and these names. No keyword, number or escape holds such a name, so the marks
    change no syntax (a text that they do break does not parse); with tabs they could move the lines of a docstring."""
    if "\\" in text or "\t" in text or not text.isascii():
        return text, ()
    parts = _NUMBERED.split(text)
    names: dict[str, int] = {}
    for i in range(1, len(parts), 2):
        parts[i] = f"\u0180{names.setdefault(parts[i], len(names))}\u0180"
    return "".join(parts), tuple(names)


def _split(text: str, indent: int) -> list[str]:
    """The pieces of a block whose statements are indented so far, each behind its indent: statements, with their decorators and branches."""
    if indent not in _STARTS:
        _STARTS[indent] = re.compile(_EDGE % (" " * indent))
    out, glue = [], False
    for x in _STARTS[indent].split(text):
        if glue or (out and x.startswith(_GOES_ON)):
            out[-1] += "\n" + " " * indent + x
        else:
            out.append(x)
        glue = x.startswith("@")
    return out


class _Parser:
    """The facts of texts as pieces with their places: statements of a module or of a class in it are parsed on their own, and those that
    differ in names with digits only are parsed once. Each must parse by itself, so that it ends where the next one starts; a text
    with one that does not is parsed whole."""

    def __init__(self, kinds: frozenset[str] | None):
        self.kinds, self.held, self.n_held = kinds, {}, 0

    def _piece(self, indent: int, text: str) -> _Piece:
        """A piece, held: of a module (indent 0), of a class body, or a whole text (indent -1), which has the facts of its module too."""
        found = self.held.get((indent, text))
        if found is None:
            tree = ast.parse("class _:\n" + " " * indent + text if indent > 0 else text)
            if indent > 0 and len(tree.body) > 1:
                raise SyntaxError
            host = tree.body[0] if indent > 0 else tree
            rows, numbers = _facts_of(host, self.kinds)
            found = _Piece([r for r in rows if r[0] or indent < 0], numbers - 1, host, int(indent > 0))
            if self.n_held > _HELD:
                self.held, self.n_held = {}, 0
            self.held[indent, text], self.n_held = found, self.n_held + found.size + 1 + len(text) // 100
        return found

    def _named(self, indent: int, text: str) -> tuple[_Piece, tuple[str, ...]]:
        skeleton, names = _skeleton(text)
        if names:
            try:
                return self._piece(indent, skeleton), names
            except SyntaxError:
                pass
        return self._piece(indent, text), ()

    def places(self, text: str) -> list[list]:
        """(piece, names, first number, number of what it stands in, lines before it, None or the last line and docstring of its module or class)."""
        try:
            if (-1, text) not in self.held and not ("\r" in text or "\0" in text or "FLUFL" in text):
                return self._pieces(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
        try:
            return [[self._piece(-1, text), (), 1, 0, 0, None]]
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []

    def _pieces(self, text: str) -> list[list]:
        out = [[self._piece(-1, ""), (), 1, 0, 0, None]]
        number, line, first = 1, 0, None
        for top in _split(text, 0):
            head = _CLASS.match(top)
            blocks = [(0, head[1] + " pass", 0)] if head else [(0, top, 0)]
            if head:
                host, at, own, indent = number, len(out), None, len(head[2])
                blocks += [(indent, x, host) for x in _split(top[head.end() :], indent)]
            here = line + head[0].count("\n") if head else line
            for i, (indent, block, host) in enumerate(blocks):
                piece, names = self._named(indent, block)
                out.append([piece, names, number, host, here if i else line, None])
                number += piece.numbers
                if i:
                    if own is None and piece.last:
                        own = piece, names
                    end = here + piece.last if piece.last else end
                    here += block.count("\n") + 1
                elif first is None and piece.last:
                    first = piece, names
            if head:
                out[at][5] = end, _doc(*own)
            line += top.count("\n") + 1
        if first is not None and first[0].doc is not None:
            out[0][5] = 1, _doc(*first)
        return [x for x in out if x[0].size]


def _doc(piece: _Piece, names: tuple[str, ...]) -> str | None:
    return piece.doc if piece.doc is None else piece.doc.format(*names)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _columns(places: list[list], taken: list[tuple[str, pa.DataType]]) -> tuple[np.ndarray, list[pa.Array]]:
    """How many facts each place has, and the columns of all of them."""
    index: dict[_Piece, int] = {}
    which = np.array([index.setdefault(p[0], len(index)) for p in places], np.int64)
    own = np.array([p.size for p in index], np.int64)
    sizes = own[which]
    begin, rows = np.cumsum(sizes) - sizes, _runs((np.cumsum(own) - own)[which], sizes)
    base, host, before = (np.repeat(np.array([p[i] for p in places], np.int64), sizes) for i in (2, 3, 4))
    heads = [(int(b) + p[0].head, p[5]) for b, p in zip(begin, places, strict=True) if p[5] is not None and p[0].head is not None]
    pool = lambda c: np.concatenate([p.cols[c] for p in index])
    number = lambda x, b, h: np.where(x == 0, h, b + x - 1)
    out = []
    for c, kind in taken:
        if pa.types.is_list(kind):
            all_sizes = pool(c + "_size")
            n, values = all_sizes[rows], pool(c)[_runs((np.cumsum(all_sizes) - all_sizes)[rows], all_sizes[rows])]
            values = number(values, np.repeat(base, n), np.repeat(host, n))
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(values, kind.value_type)))
        elif c in ("name", "doc"):
            texts = list(chain.from_iterable(p.texts[c] for p in index))
            texts = [texts[i] for i in rows.tolist()]
            for b, (piece, names, *_) in zip(begin.tolist(), places, strict=True):
                for i, of, form in piece.marks if names else ():
                    if of == c:
                        texts[b + i] = form.format(*names)
            for i, (_, doc) in heads if c == "doc" else ():
                texts[i] = doc
            out.append(pa.array(texts, kind))
        else:
            values = pool(c)[rows]
            if c in ("line", "end_line"):
                values = values + before
            for i, (end, doc) in heads:
                if c == "end_line":
                    values[i] = end
                elif c == "flag":
                    values[i] = doc is not None
            if c == "kind":
                out.append(pa.array(_KINDS, kind).take(pa.array(values)))
            elif c.endswith("_id"):
                out.append(pa.array(number(values, base, host), kind, mask=values < 0))
            else:
                out.append(pa.array(values, kind))
    return sizes, out


def parsed(files: DataFrame, key: str, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of files (the columns of `key`, and content, in bytes), file by file, behind their keys. Key is a schema. Only facts of some
    kinds, with some columns besides kind, are made where these are given. Of statements that are equal, but for names with digits, and that
    come near each other one is parsed."""
    fields = [c for c in NODE.split(", ") if columns is None or c.split()[0] in (*columns, "kind")]
    schema = ", ".join([key, *fields])
    keys = [c.split()[0] for c in key.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    taken = [(c.split()[0], types[c.split()[1]]) for c in fields]
    wanted = None if kinds is None else frozenset(kinds)

    def facts_batch(batch: pa.RecordBatch, places: list[list], at: list[int]) -> pa.RecordBatch:
        sizes, own = _columns(places, taken)
        of = pa.array(np.repeat(np.array(at, dtype=np.int64), sizes))
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), *own], [*keys, *(n for n, _ in taken)])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser(wanted)
        for batch in batches:
            places, at, total = [], [], 0
            for i, content in enumerate(batch.column("content").to_pylist()):
                own = parser.places((content or b"").decode("utf-8", "ignore"))
                places += own
                at += [i] * len(own)
                total += sum(p[0].size for p in own)
                if total >= _ROWS:
                    yield facts_batch(batch, places, at)
                    places, at, total = [], [], 0
            if total:
                yield facts_batch(batch, places, at)

    return files.select(*keys, "content").mapInArrow(extract, schema)


def facts(files: DataFrame, *metrics: str) -> DataFrame:
    """Facts of files (repo_id, path, content), file by file; those that do not parse, null or empty ones give at most their module's.
    Content may be text or bytes; bytes that are not UTF-8 are dropped. Facts are written once in the shared folder, since most metrics
    read them several times. With the names of metrics (see NEEDS), only what these read is made and written."""
    every = [NEEDS[m] for m in metrics]
    kinds = tuple({x for k, _ in every for x in k}) if every and all(k is not None for k, _ in every) else None
    columns = tuple({x for _, c in every for x in c}) if every else None
    given = files.select(F.col("repo_id").cast("long").alias("repo_id"), "path", F.col("content").cast("binary").alias("content"))
    return cut(parsed(given, "repo_id long, path string", kinds, columns))


def _kind(f: DataFrame, *kinds: str) -> DataFrame:
    return f.where(F.col("kind").isin(*kinds))


def _public(name: str = "name") -> Column:
    return ~F.col(name).rlike("^__.*__$")


def kind_counts(f: DataFrame) -> DataFrame:
    """(kind, facts): how many facts there are of each kind."""
    return f.groupBy("kind").agg(F.count("*").alias("facts"))


def class_sizes(f: DataFrame, lines: int = 200, methods: int = 20) -> DataFrame:
    """(repo_id, path, name, lines, methods): classes beyond either size."""
    own = _kind(f, "FunctionDef").groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(F.count("*").alias("methods"))
    out = _kind(f, "ClassDef").join(own, [*KEY, "node_id"], "left").select(*KEY, "name", (F.col("end_line") - F.col("line") + 1).alias("lines"), F.coalesce("methods", F.lit(0)).alias("methods"))
    return out.where((F.col("lines") > lines) | (F.col("methods") > methods))


def instance_variables(f: DataFrame, most: int = 15) -> DataFrame:
    """(repo_id, path, class_id, variables): classes with more distinct attributes of self."""
    own = _kind(f, "Attribute").where(F.col("name").rlike(r"^self\.\w+$"))
    return own.groupBy(*KEY, "class_id").agg(F.count_distinct("name").alias("variables")).where(F.col("variables") > most)


def multiple_inheritance(f: DataFrame) -> DataFrame:
    """(repo_id, path, class_id, bases): classes with several bases, none of them a Mixin or ABC."""
    out = _kind(f, "Base").groupBy(*KEY, "class_id").agg(F.count("*").alias("bases"), F.max(F.col("name").rlike("Mixin|ABC")).alias("allowed"))
    return out.where("bases > 1 AND NOT allowed").drop("allowed")


def function_sizes(f: DataFrame, lines: int = 30, parameters: int = 3) -> DataFrame:
    """(repo_id, path, name, line, lines, parameters): functions beyond either size; those with double underscores are left out."""
    out = _kind(f, "FunctionDef").where(_public()).select(*KEY, "name", "line", (F.col("end_line") - F.col("line") + 1).alias("lines"), F.col("n").alias("parameters"))
    return out.where((F.col("lines") > lines) | (F.col("parameters") > parameters))


def cyclomatic(f: DataFrame, over: int = 10) -> DataFrame:
    """(repo_id, path, name, line, complexity, severity): 1, and 1 for each if, while, for, except, and as many as the values of a condition."""
    weight = F.when(F.col("kind") == "BoolOp", F.col("n")).otherwise(1)
    per = _kind(f, "If", "While", "For", "ExceptHandler", "BoolOp").select(*KEY, F.explode("funcs").alias("node_id"), weight.alias("w")).groupBy(*KEY, "node_id").agg(F.sum("w").alias("w"))
    out = _kind(f, "FunctionDef").join(per, [*KEY, "node_id"], "left").select(*KEY, "name", "line", (F.coalesce("w", F.lit(0)) + 1).alias("complexity"))
    return out.where(F.col("complexity") > over).withColumn("severity", F.when(F.col("complexity") > 20, "HIGH").otherwise("MEDIUM"))


def loop_nesting(f: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(repo_id, path, line, depth, severity): for and while loops with such loops directly in them, and how many levels there are of
    those. A level is one join of what is left with its own next, so code of depth d takes d rounds. Async loops do not count."""
    loops = cut(_kind(f, "For", "While").select(*KEY, "line", "node_id", "parent_id"))
    level = loops.select(*KEY, "line", F.col("node_id").alias("top"), F.col("node_id").alias("at"))
    inner = loops.select(*KEY, "node_id", F.col("parent_id").alias("at"))
    found = None
    for depth in range(2, max_depth + 1):
        level = cut(level.join(inner, [*KEY, "at"]).select(*KEY, "line", "top", F.col("node_id").alias("at")))
        if level.isEmpty():
            break
        here = level.select(*KEY, "line", "top", F.lit(depth).alias("depth"))
        found = here if found is None else found.union(here)
    found = level.select(*KEY, "line", "top", F.lit(0).alias("depth")) if found is None else found
    per = found.groupBy(*KEY, "line", "top").agg(F.max("depth").alias("depth")).drop("top")
    return per.withColumn("severity", F.when(F.col("depth") >= 3, "HIGH").otherwise("MEDIUM"))


def calls_and_asserts(f: DataFrame) -> DataFrame:
    """(repo_id, path, line, kind): assert statements, requests calls without a timeout, list() calls."""
    kind = F.when(F.col("kind") == "Assert", "assert").when((F.col("kind") == "Call") & F.col("name").startswith("requests.") & ~F.col("flag"), "no_timeout").when((F.col("kind") == "Call") & (F.col("name") == "list"), "list")
    return f.where(kind.isNotNull()).select(*KEY, "line", kind.alias("kind"))


def doc_coverage(f: DataFrame) -> DataFrame:
    """(repo_id, documented, total, coverage in per cent) over modules, classes and functions."""
    out = _kind(f, "FunctionDef", "ClassDef", "Module").groupBy("repo_id").agg(F.count_if("flag").alias("documented"), F.count("*").alias("total"))
    return out.withColumn("coverage", F.col("documented") / F.col("total") * 100)


def test_quality(f: DataFrame) -> DataFrame:
    """(repo_id, path, name, problem, severity) of test functions: no assertion, over 5 of them, over 50 lines."""
    asserts = (F.col("kind") == "Assert") | ((F.col("kind") == "Call") & F.col("name").rlike(r"\.\w*assert\w*$"))
    per = f.where(asserts).select(*KEY, F.explode("funcs").alias("node_id")).groupBy(*KEY, "node_id").agg(F.count("*").alias("k"))
    t = _kind(f, "FunctionDef").where(F.col("name").startswith("test")).join(per, [*KEY, "node_id"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    hit = lambda when, what, how: F.when(when, F.struct(F.lit(what).alias("problem"), F.lit(how).alias("severity")))
    out = t.withColumn("p", F.explode(F.array_compact(F.array(hit(F.col("k") == 0, "no_assertion", "HIGH"), hit(F.col("k") > 5, "many_assertions", "LOW"), hit(F.col("end_line") - F.col("line") > 50, "long", "MEDIUM")))))
    return out.select(*KEY, "name", "p.problem", "p.severity")


def code_nodes(f: DataFrame) -> DataFrame:
    """(repo_id, id, node_type, name, path) of each repository's code graph: files, classes, functions, methods; of an id of a repository the
    last in the code is kept."""
    cls = _kind(f, "ClassDef").select(*KEY, F.col("node_id").alias("parent_id"), F.col("name").alias("owner"))
    named = _kind(f, "FunctionDef", "ClassDef").join(cls, [*KEY, "parent_id"], "left")
    kind = F.when(F.col("kind") == "ClassDef", "class").when(F.col("owner").isNotNull(), "method").otherwise("function")
    out = named.select("repo_id", F.concat("path", F.lit("::"), F.when(kind == "method", F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))).alias("id"), kind.alias("node_type"), "name", "path", "line", "node_id")
    every = out.union(_kind(f, "Module").select("repo_id", "path", F.lit("file"), "path", "path", F.lit(0), F.lit(0)))
    last = F.max(F.struct("line", "node_id", "node_type", "name", "path")).alias("last")
    return every.groupBy("repo_id", "id").agg(last).select("repo_id", "id", "last.node_type", "last.name", "last.path")


def structural_edges(f: DataFrame) -> DataFrame:
    """(repo_id, source_id, target_id, edge_type) of each repository's code graph: a file defines its classes and functions, a class contains its methods and
    inherits from its bases, which are named as they stand in the code; each edge once."""
    cls = _kind(f, "ClassDef").select(*KEY, F.col("node_id").alias("parent_id"), F.col("name").alias("owner"))
    named = _kind(f, "FunctionDef", "ClassDef", "Base").join(cls, [*KEY, "parent_id"], "left")
    at = lambda *parts: F.concat("path", F.lit("::"), *parts)
    base, method = F.col("kind") == "Base", (F.col("kind") == "FunctionDef") & F.col("owner").isNotNull()
    source = F.when(base | method, at("owner")).otherwise(F.col("path"))
    target = F.when(base, F.col("name")).when(method, at("owner", F.lit("."), "name")).otherwise(at("name"))
    kind = F.when(base, "inherits").when(method, "contains").otherwise("defines")
    return named.where(~base | (F.col("name") != "")).select("repo_id", source.alias("source_id"), target.alias("target_id"), kind.alias("edge_type")).distinct()


def couplings(f: DataFrame, most: int = 10) -> DataFrame:
    """(repo_id, path, name, line, names): classes in which more distinct names occur, self and cls left out."""
    used = _kind(f, "Name").where(~F.col("name").isin("self", "cls")).select(*KEY, F.explode("classes").alias("node_id"), F.col("name").alias("used"))
    per = used.groupBy(*KEY, "node_id").agg(F.count_distinct("used").alias("names")).where(F.col("names") > most)
    return _kind(f, "ClassDef").join(per, [*KEY, "node_id"]).select(*KEY, "name", "line", "names")


def feature_envy(f: DataFrame, most: int = 5) -> DataFrame:
    """(repo_id, path, name, line, root, accesses): functions that read attributes of another name more often; those with double underscores are left out."""
    one = _kind(f, "Attribute").where(F.col("name").rlike(r"^[^.]+\.[^.]+$") & ~F.col("name").startswith("self."))
    per = one.select(*KEY, F.explode("funcs").alias("node_id"), F.substring_index("name", ".", 1).alias("root")).groupBy(*KEY, "node_id", "root").agg(F.count("*").alias("accesses")).where(F.col("accesses") > most)
    return _kind(f, "FunctionDef").where(_public()).join(per, [*KEY, "node_id"]).select(*KEY, "name", "line", "root", "accesses")


def _problems(*cases: tuple[Column, str, Column | str]) -> Column:
    """One row for each case (condition, problem, severity) that holds."""
    return F.explode(F.array_compact(F.array(*[F.when(when, F.struct(F.lit(what).alias("problem"), (how if isinstance(how, Column) else F.lit(how)).alias("severity"))) for when, what, how in cases])))


def module_checks(f: DataFrame, files: DataFrame, code_lines: int = 1000, imports: int = 20, from_imports: int = 30, classes: int = 10) -> DataFrame:
    """(repo_id, path, problem, severity, code_lines, imports, classes) of files that parse: too many lines with code, imports
    (more than `from_imports` of names out of modules count again, as low), classes."""
    code = F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(r"^\s*[^\s#]")))
    size = files.select(F.col("repo_id").cast("long").alias("repo_id"), "path", code.alias("code_lines"))
    kind = F.col("kind")
    per = _kind(f, "Module", "Import", "ImportFrom", "ClassDef").groupBy(*KEY).agg(
        F.count_if(kind.isin("Import", "ImportFrom")).alias("imports"), F.count_if((kind == "ImportFrom") & F.col("name").isNotNull()).alias("froms"), F.count_if(kind == "ClassDef").alias("classes")
    )
    found = _problems((F.col("code_lines") > code_lines, "lines", "MEDIUM"), (F.col("imports") > imports, "imports", "MEDIUM"), (F.col("classes") > classes, "classes", "MEDIUM"), (F.col("froms") > from_imports, "from_imports", "LOW"))
    return per.join(size, list(KEY)).withColumn("p", found).select(*KEY, "p.problem", "p.severity", "code_lines", "imports", "classes")


def loop_smells(f: DataFrame, repeats: int = 3) -> DataFrame:
    """(repo_id, path, line, smell, severity, detail) of for and while loops: a list comprehension in them (line: the first one's),
    an addition in place, a query call, an attribute (detail) that is read more than `repeats` times."""
    inner = _kind(f, "ListComp", "AugAssign", "Attribute", "Call").select(*KEY, F.explode("loops").alias("node_id"), F.col("kind").alias("k"), F.regexp_replace("name", r"^\.", "").alias("attr"), F.col("line").alias("at"))
    loops = _kind(f, "For", "While").select(*KEY, "node_id", "line")
    query = F.when(F.col("k") == "Attribute", F.substring_index("attr", ".", -1)).when(F.col("k") == "Call", F.col("attr")).isin(*QUERY_CALLS)
    per = inner.groupBy(*KEY, "node_id").agg(F.min(F.when(F.col("k") == "ListComp", F.col("at"))).alias("comp"), F.max((F.col("k") == "AugAssign") & (F.col("attr") == "Add")).alias("add"), F.max(F.coalesce(query, F.lit(False))).alias("query"))
    found = _problems((F.col("comp").isNotNull(), "list_comprehension", "MEDIUM"), (F.col("add"), "concatenation", "MEDIUM"), (F.col("query"), "query", "HIGH"))
    one = loops.join(per, [*KEY, "node_id"]).withColumn("p", found)
    line = F.when(F.col("p.problem") == "list_comprehension", F.col("comp")).otherwise(F.col("line"))
    often = inner.where("k = 'Attribute'").groupBy(*KEY, "node_id", "attr").agg(F.count("*").alias("reads")).where(F.col("reads") > repeats)
    return one.select(*KEY, line.alias("line"), F.col("p.problem").alias("smell"), "p.severity", F.lit(None).cast("string").alias("detail")).union(
        loops.join(often, [*KEY, "node_id"]).select(*KEY, "line", F.lit("repeated_attribute"), F.lit("LOW"), "attr"))


def doc_issues(f: DataFrame) -> DataFrame:
    """(repo_id, path, name, line, problem, severity): modules, classes and functions without a docstring, classes with one of under
    20 characters, and documented functions whose docstring lacks the section for their parameters, returned values or exceptions.
    Functions whose name starts with a single underscore are left out."""
    node = F.explode(F.when(F.col("kind") == "Param", F.array("parent_id")).otherwise(F.col("funcs"))).alias("node_id")
    kind = F.col("kind")
    uses = _kind(f, "Param", "Return", "Raise").where((kind != "Param") | (F.col("name") != "self")).select(*KEY, node, "kind", "flag")
    per = uses.groupBy(*KEY, "node_id").agg(F.max(kind == "Param").alias("params"), F.max((kind == "Return") & F.col("flag")).alias("returns"), F.max(kind == "Raise").alias("raises"))
    private = (kind == "FunctionDef") & F.col("name").rlike("^_(?!_)")
    t = _kind(f, "FunctionDef", "ClassDef", "Module").where(~private).join(per, [*KEY, "node_id"], "left")
    is_function, public, none = kind == "FunctionDef", (kind != "Module") & ~F.col("name").startswith("_"), ~F.col("flag") | (F.col("doc") == "")
    lacks = lambda use, heads: is_function & ~none & F.coalesce(use, F.lit(False)) & ~F.col("doc").rlike("|".join(heads))
    found = _problems(
        (none, "no_docstring", F.when(public, "HIGH").when(is_function, "LOW").otherwise("MEDIUM")),
        (~none & (kind == "ClassDef") & (F.length("doc") < 20), "short_docstring", "LOW"),
        (lacks(F.col("params"), PARAMETER_HEADS), "no_parameter_section", "MEDIUM"),
        (lacks(F.col("returns"), RETURN_HEADS), "no_return_section", "MEDIUM"),
        (lacks(F.col("raises"), RAISE_HEADS), "no_exception_section", "LOW"),
    )
    return t.withColumn("p", found).select(*KEY, "name", "line", "p.problem", "p.severity")
