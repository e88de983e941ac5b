"""Code graphs: neighbours, impact sets, import graphs, cycles, domains, layers.

Edges have source_id, target_id, edge_type; nodes have id and node_type.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.lineage import CELL, cell_join, cut, hub_join


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()


def neighbours(edges: DataFrame, nodes: DataFrame, edge_type: str | None = None, incoming: bool = False) -> DataFrame:
    """(id, neighbour): what a node depends on, or what depends on it; only neighbours that exist as nodes."""
    e = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    a, b = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    pairs = e.select(F.col(a).alias("id"), F.col(b).alias("neighbour")).distinct()
    return pairs.join(nodes.select(F.col("id").alias("neighbour")), "neighbour", "left_semi").select("id", "neighbour")


def by_type(rows: DataFrame, kind: str, col: str = "edge_type") -> DataFrame:
    """Edges of a type; nodes of a type, with col = node_type."""
    return rows.where(F.col(col) == kind)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, type, count): nodes and edges of each type."""
    n = lambda rows, part, col: rows.groupBy(F.col(col).alias("type")).agg(F.count("*").alias("count")).select(F.lit(part).alias("part"), "type", "count")
    return n(nodes, "node", "node_type").union(n(edges, "edge", "edge_type"))


#: Pairs of a step of impact() that one task works on, about; and a seed's ids that are held at once, in cells.
PAIRS, HELD = 2_000_000, 16


def _lists(moves: DataFrame, degree: DataFrame, cell: int = CELL) -> DataFrame:
    """(id, part, ids): what follows each id by distinct moves (id, next), in lists of about `cell` at most; degree has the number n of an id's moves."""
    big = degree.where(F.col("n") > cell).select("id", F.ceil(F.col("n") / cell).alias("parts"))
    dealt = moves.withColumn("part", F.lit(0)) if big.isEmpty() else hub_join(moves, big, "id", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("next"), "parts").cast("int"), F.lit(0)))
    return dealt.groupBy("id", "part").agg(F.sort_array(F.collect_list("next")).alias("ids"))


#: Ids of a batch that leaves a Python worker, about.
SENT = 100_000


def packed(ids: list[bytes]) -> bytes:
    """Ids as one compressed text, each with an end; sorted ones, which share their beginnings, take a few bytes each."""
    return zlib.compress(b"".join([x.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") + b"\0" for x in ids]))


def unpacked(raw: bytes) -> list[bytes]:
    text = zlib.decompress(raw)
    ids = text.split(b"\0")[:-1]
    return [x.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1") for x in ids] if b"\1" in text else ids


@F.pandas_udf(BinaryType())
def _pack(ids: pd.Series) -> pd.Series:
    return pd.Series([packed([x.encode() for x in row]) for row in ids], dtype=object)


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, ids): the distinct ids of the packed lists `ids` of each seed but for those of its lists `past` and itself."""

    def batch(seeds: list[str], found: list[list[bytes]]) -> pa.RecordBatch:
        values = pa.array([x for ids in found for x in ids], pa.binary()).cast(pa.string())
        ends = pa.array([0, *pd.Series(map(len, found), dtype="int32").cumsum()], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(seeds, pa.string()), pa.ListArray.from_arrays(ends, values)], ["seed", "ids"])

    for rows in batches:
        seeds, found, held = [], [], 0
        for seed, ids, past in zip(*(rows.column(c) for c in ("seed", "ids", "past")), strict=True):
            new = set().union(*map(unpacked, ids.as_py()))
            new.difference_update(*(unpacked(raw) for raw in past.as_py()), (seed.as_py().encode(),))
            if new:
                seeds.append(seed.as_py())
                found.append(list(new))
                held += len(new)
            if held >= SENT:
                yield batch(seeds, found)
                seeds, found, held = [], [], 0
        if seeds:
            yield batch(seeds, found)


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, cell: int = CELL) -> DataFrame:
    """(seed, id, distance): for every seed (id) the nodes that reach it over fewer than max_depth edges, itself left out. Null ids
    are no nodes; a seed that repeats counts once.

    The dependants of a node travel as packed lists of about `cell` ids at most, not as rows: a step joins what it last reached with these
    lists, and a seed unpacks its lists and takes the distinct ids but for those that it knows. Joins go by cells, as a node may have very many dependants
    and be reached from very many seeds. Seeds that may meet more than HELD cells of ids go on by rows, so that no group is large."""
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    back = cut(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("next")).where("id IS NOT NULL AND next IS NOT NULL").distinct())
    known = seeds.select("id").where("id IS NOT NULL").distinct()
    degree = cut(back.groupBy("id").agg(F.count("*").alias("n")))
    lists = cut(_lists(back, degree, cell).withColumn("raw", _pack("ids")))
    front = lists.join(known, "id", "left_semi").select(F.col("id").alias("seed"), F.array_remove("ids", F.col("id")).alias("ids"))
    front = cut(front)
    found = front.withColumn("distance", F.lit(1)) if max_depth > 1 else front.select("seed", "ids", F.lit(0).alias("distance")).where("false")
    seen = front
    for distance in range(2, max_depth):
        moves = cut(front.select("seed", F.explode("ids").alias("id")))
        ahead = cell_join(moves, degree, "id", "seed", "n", cell=cell).groupBy("seed").agg(F.sum("n").alias("n"))
        past = seen.groupBy("seed").agg(F.sum(F.size("ids")).alias("past"))
        sizes = cut(ahead.join(past, "seed").select("seed", "n", "past"))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        tasks = max(width, total // PAIRS)
        wide = cut(sizes.where(F.col("n") + F.col("past") > HELD * cell).select("seed"))
        many = not wide.isEmpty()
        split = (lambda df, how: hub_join(df, wide, "seed", how)) if many else (lambda df, how: df)  # noqa: B023
        met = cell_join(split(moves, "left_anti"), lists.select("id", "part", "raw"), "id", "seed", "part", cell=cell, right_cell=1, tasks=tasks)
        both = met.select("seed", "raw", F.lit(True).alias("fresh")).union(split(seen, "left_anti").select("seed", _pack("ids"), F.lit(False)))
        per = both.repartition(tasks, "seed").groupBy("seed").agg(F.expr("collect_list(raw) FILTER (WHERE fresh)").alias("ids"), F.expr("collect_list(raw) FILTER (WHERE NOT fresh)").alias("past"))
        front = per.mapInArrow(_fresh, "seed string, ids array<string>")
        if many:
            rows = cell_join(split(moves, "left_semi"), lists.select("id", "part", "ids"), "id", "seed", "part", cell=cell, right_cell=1, tasks=tasks).select("seed", F.explode("ids").alias("id")).where("seed <> id").distinct()
            new = rows.join(split(seen, "left_semi").select("seed", F.explode("ids").alias("id")), ["seed", "id"], "left_anti")
            front = front.union(new.select("seed", F.array("id")))
        if distance < max_depth - 1:
            front = cut(front)
            seen = seen.union(front)
        found = found.union(front.withColumn("distance", F.lit(distance)))
    return found.select("seed", F.explode("ids").alias("id"), "distance")


def import_graph(source_lines: DataFrame) -> DataFrame:
    """(repo_id, path, module): root modules that the lines of a file import; names that start with an underscore are left out."""
    root = F.regexp_extract("text", r"^\s*(?:import|from)\s+([A-Za-z][A-Za-z0-9_]*)", 1)
    return source_lines.select("repo_id", "path", root.alias("module")).where("module <> ''").distinct()


def cycles(edges: DataFrame, longest: int = 5, cell: int = CELL) -> DataFrame:
    """(members, length, severity): all simple cycles of up to `longest` nodes, as the sorted set of their members; over 4 are CRITICAL.
    Edges that no cycle can hold, into nodes without an edge out or out of nodes without one in, are trimmed first, while that helps. The
    number of paths grows with the power `longest` of the degree, so that longer cycles are not listed.

    A path carries the nodes that lead back to its start, as lists of about `cell` at most. Its last node but one meets the list of what
    follows it, and what both lists hold closes the cycle, so that paths of all nodes but the last are the longest that are sent."""
    e = edges.select("source_id", "target_id").where("source_id <> target_id").distinct()
    before = None
    for _ in range(longest):
        e = e.join(e.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi").join(e.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi")
        e = cut(e.select("source_id", "target_id"))
        n = e.count()
        if before is not None and before < 1.1 * n:
            break
        before = n
    count = lambda moves: moves.groupBy("id").agg(F.count("*").alias("n"))
    step = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("next"))
    after = _lists(step, count(step), cell).select(F.col("id").alias("at"), F.col("ids").alias("after"))
    # a path starts at its smallest node, so that each cycle is walked from one place only
    back = e.where("source_id > target_id").select(F.col("target_id").alias("id"), F.col("source_id").alias("next"))
    ends = _lists(back, count(back), cell).select("id", F.col("ids").alias("ends"))
    first = e.where("source_id < target_id").select(F.col("source_id").alias("id"), F.array("source_id", "target_id").alias("path"))
    kept = lambda path, length: path.select(F.array_join(F.array_sort("path"), ",").alias("members"), F.lit(length).alias("length"))
    paths = first.join(ends, "id").select("path", "ends")
    found = kept(paths.where(F.array_contains("ends", F.col("path")[1])), 2)
    for n in range(3, longest):
        ahead = paths.join(step, F.element_at("path", -1) == F.col("id")).where((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next")))
        paths = ahead.select(F.concat("path", F.array("next")).alias("path"), "ends")
        found = found.union(kept(paths.where(F.array_contains("ends", F.col("path")[n - 1])), n))
    if longest > 2:
        closing = F.array_except(F.array_intersect("after", "ends"), "path")
        last = paths.join(after, F.element_at("path", -1) == F.col("at")).select("path", F.explode(closing).alias("end"))
        found = found.union(kept(last.select(F.concat("path", F.array("end")).alias("path")), longest))
    return found.distinct().withColumn("severity", F.when(F.col("length") > 4, "CRITICAL").otherwise("HIGH"))


#: Edges up to which labels are joined plainly, in one task each: no node can be a hub then.
FEW = 100_000


def _least_reaching(edges: DataFrame, nodes: DataFrame, max_rounds: int, few: bool) -> DataFrame:
    """(id, label): the least node that reaches each node (itself included) along edges (source_id, target_id). Labels are taken from
    neighbours and, as reaching is transitive, from their own labels, so that they jump: a path takes about the logarithm of its length."""
    meet = (lambda a, b, c, how="inner": a.join(b, c, how)) if few else hub_join
    keep = (lambda df: cut(df.coalesce(1))) if few else cut
    labels = keep(nodes.select("id", F.col("id").alias("label")))
    for _ in range(max_rounds):
        near = meet(edges, labels.withColumnRenamed("id", "source_id"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min("label").alias("near"))
        step = keep(labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.coalesce(F.least("label", "near"), "label").alias("label")))
        new = keep(meet(step, step.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def strong_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): the nodes of each strongly connected component of two nodes or more, named by its smallest node.

    Nodes that no cycle can hold are trimmed. Every other node gets the least node, in an order at random, that reaches it as its colour; edges between
    colours are in no component. Inside a colour, the nodes that reach the colour's own node are one component. It is taken
    out, and what is left goes round again; every round takes out at least the component of each colour.
    """
    keyed = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), c).alias(c)  # noqa: E731  at random, so that labels jump on any path
    e = cut(edges.where("source_id <> target_id").select(keyed("source_id"), keyed("target_id")).distinct())
    found = None
    for _ in range(max_rounds):
        before = -1
        while before != (n := e.count()):  # trim; a chain takes one step for each node, so only while it helps much
            if 0 <= before < 1.1 * n:
                break
            before = n
            e = e.join(e.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi").join(e.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi")
            e = cut(e.select("source_id", "target_id"))
        if n == 0:
            break
        few = n <= FEW
        colour = _least_reaching(e, nodes_of(e), max_rounds, few)
        a, b = (colour.select(F.col("id").alias(c), F.col("label").alias(x)) for c, x in (("source_id", "a"), ("target_id", "b")))
        own = cut(e.join(a, "source_id").join(b, "target_id").where("a = b").select("source_id", "target_id"))
        back = _least_reaching(own.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), nodes_of(own), max_rounds, few)
        done = cut(back.join(colour.withColumnRenamed("label", "colour"), "id").where("label = colour").select("id", F.col("colour").alias("component")))
        found = done if found is None else found.union(done)
        for c in ("source_id", "target_id"):
            own = own.join(done.select(F.col("id").alias(c)), c, "left_anti")
        e = cut(own.select("source_id", "target_id"))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if found is None:
        return e.select(F.col("source_id").alias("id"), F.col("source_id").alias("component"))
    own = found.select(F.substr("id", F.lit(17)).alias("id"), F.col("component").alias("key"))
    name = own.groupBy("key").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return hub_join(own, name, "key").select("id", "component")


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(component, size, severity): cyclic dependencies of any length, as components; over 4 nodes are CRITICAL."""
    size = strong_components(edges).groupBy("component").agg(F.count("*").alias("size"))
    return size.withColumn("severity", F.when(F.col("size") > 4, "CRITICAL").otherwise("HIGH"))


def domain_leaks(edges: DataFrame, least: int = 3) -> DataFrame:
    """(domain_a, domain_b, imports): pairs of domains (first part of the id) with that many edges between them."""
    d = lambda c: F.substring_index(c, ".", 1)
    t = edges.select(d("source_id").alias("a"), d("target_id").alias("b")).where("a <> b")
    return t.groupBy(F.least("a", "b").alias("domain_a"), F.greatest("a", "b").alias("domain_b")).agg(F.count("*").alias("imports")).where(F.col("imports") >= least)


#: Layers up to which each edge is matched with all of them where it lies, without a join.
LAYERS = 1000


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(from_layer, to_layer, violations): edges from a layer to a higher one, by layers (name, level); a node's layer is the first, by level
    and name, whose name it contains. Up to LAYERS layers go into the plan and an edge is read once; more meet the nodes by a join."""
    known = layers.select("level", "name").where("name IS NOT NULL").orderBy("level", "name").limit(LAYERS + 1).collect()
    if 0 < len(known) <= LAYERS:
        every = F.array(*[F.struct(F.lit(r["level"]).alias("level"), F.lit(r["name"]).alias("name")) for r in known])
        first = lambda c: F.get(F.filter(every, lambda x: F.col(c).contains(x["name"])), F.lit(0))
        named = edges.select(first("source_id").alias("a"), first("target_id").alias("b")).where("a.level > b.level").select(F.col("a.name").alias("from_layer"), F.col("b.name").alias("to_layer"))
    else:
        names = nodes_of(edges)
        own = names.join(layers, names["id"].contains(layers["name"])).groupBy("id").agg(F.min(F.struct("level", "name")).alias("l"))
        a = own.select(F.col("id").alias("source_id"), F.col("l.name").alias("from_layer"), F.col("l.level").alias("x"))
        b = own.select(F.col("id").alias("target_id"), F.col("l.name").alias("to_layer"), F.col("l.level").alias("y"))
        named = hub_join(hub_join(edges.select("source_id", "target_id"), a, "source_id"), b, "target_id").where("x > y")
    return named.groupBy("from_layer", "to_layer").agg(F.count("*").alias("violations"))


def module_index(files: DataFrame) -> DataFrame:
    """(repo_id, module, path): the dotted name of each file of a repository; and its stem, for the first path by name, where no dotted
    name of the repository is the same."""
    key = ["repo_id", "module"]
    dotted = files.select("repo_id", F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("module"), "path").distinct()
    stems = dotted.select("repo_id", F.substring_index("module", ".", -1).alias("module"), "path").groupBy(*key).agg(F.min("path").alias("path"))
    return dotted.union(stems.join(dotted.select(*key), key, "left_anti").select("repo_id", "module", "path"))


def import_edges(imports: DataFrame, index: DataFrame) -> DataFrame:
    """(repo_id, source, target): imports (repo_id, path, module) resolved by an index (repo_id, module, path) of the same repository: the
    full name, else the longest known prefix, else the last segment; no edge to itself."""
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("name")))
    each = imports.select("repo_id", "path", "module", F.explode(F.concat(prefixes, F.array(F.struct(F.lit(0).alias("n"), F.substring_index("module", ".", -1).alias("name"))))).alias("p"))
    hit = each.select("repo_id", F.col("path").alias("source"), "module", "p.n", "p.name").join(index.select("repo_id", F.col("module").alias("name"), F.col("path").alias("target")), ["repo_id", "name"])
    best = hit.groupBy("repo_id", "source", "module").agg(F.max_by("target", "n").alias("target"))
    return best.where("source <> target").select("repo_id", "source", "target").distinct()


def call_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, caller, callee): calls (repo_id, path, caller, name) resolved to functions (repo_id, path, name, id) of the same
    repository. self. is dropped; an exact name beats its last segment, and then the same file beats others; all that tie are
    kept. No edge to itself."""
    full = F.regexp_replace("name", r"^self\.", "")
    rest = cut(calls.select("repo_id", "path", "caller", full.alias("full"), F.substring_index(full, ".", -1).alias("last")).distinct())
    found = None
    for key, same_file in (("full", True), ("full", False), ("last", True), ("last", False)):  # only what is still open goes on to the wider match
        on = ["repo_id", key, "path"] if same_file else ["repo_id", key]
        f = functions.select("repo_id", F.col("name").alias(key), *(["path"] if same_file else []), F.col("id").alias("callee"))
        hit = rest.join(f, on).select("repo_id", "caller", "callee")
        found = hit if found is None else found.union(hit)
        rest = rest.join(f.select(*on).distinct(), on, "left_anti")
    return found.where("caller <> callee").distinct()


def clusters(edges: DataFrame, least: int = 3, max_rounds: int = 60) -> DataFrame:
    """(cluster, nodes, internal_edges): groups of at least that many nodes that pairs of edges in both directions connect, named by
    their smallest node, and the distinct edges inside. Labels spread along edges and jump along labels until none changes;
    labels that very many nodes share meet a broadcast of their rows."""
    e = edges.select("source_id", "target_id").where("source_id <> target_id").distinct()
    both = cut(e.join(e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), ["source_id", "target_id"], "left_semi"))
    labels = cut(both.groupBy(F.col("source_id").alias("id")).agg(F.least(F.col("id"), F.min("target_id")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels, both["target_id"] == labels["id"]).groupBy(F.col("source_id").alias("id")).agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = cut(hub_join(step, jump, "label").select("id", "old", F.col("far").alias("label")))
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    a, b = (labels.select(F.col("id").alias(c), F.col("label").alias(n)) for c, n in (("source_id", "cluster"), ("target_id", "other")))
    inside = e.join(a, "source_id").join(b, "target_id").where("cluster = other").groupBy("cluster").agg(F.count("*").alias("internal_edges"))
    return labels.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("nodes")).where(F.col("nodes") >= least).join(inside, "cluster")
