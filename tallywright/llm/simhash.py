"""SimHash fingerprints and near-duplicate groups by tiled exact comparison.

Fingerprints are dealt into tiles in the order of their population counts. Two fingerprints within radius r have
population counts that differ by r at most, so a pair of tiles whose counts lie further apart is never looked at. Each
remaining pair of tiles is one unit of work: numpy compares blocks by exclusive-or and bit counts, and again skips
blocks by the counts of both halves. A unit keeps a spanning forest of the links that it finds, not all of them, so a
group of near copies costs one row for each member. The number of tiles is fixed up to TILES * TILE fingerprints, so that
what is sent between executors grows with their number; beyond that there are more tiles and units, and copies sent grow
with the square of the number of fingerprints, as the comparisons do at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import hub_join
from .common import MIX, components, mixed, shuffle_width, small_batches, text_bytes, written

#: Tiles there are, whatever the number of fingerprints, so that each fingerprint is sent equally often at every size;
#: and the most fingerprints of a tile, beyond which there are more tiles.
TILES, TILE = 32, 250_000
_SPREAD = np.frombuffer(((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8).tobytes(), np.uint64)  # each bit of a byte in a byte of its own


def shingle_hashes(text: bytes, ngram: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `ngram` words, joined by spaces, after A-Z are lower-cased; repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= ngram:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-ngram] + 1].tolist()
    view = memoryview(line)
    return np.fromiter((xxhash.xxh64_intdigest(view[a:b], 42) for a, b in zip(starts, ends[ngram - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes. Bits are counted in eight byte-wide lanes at a time."""
    out, n = 0, len(h)
    for byte in range(8):
        lanes = _SPREAD[((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)]
        sums = np.add.reduceat(lanes, np.arange(0, n, 255)).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64) if n else np.zeros(8, np.int64)
        for bit in range(8):
            out |= int(2 * sums[bit] > n) << (8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, ngram: int = 3, words: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, f0, f1, ..): `words` 64-bit words of the SimHash of each text, as signed longs. The first word is of the
    shingles' XXH64, the others of mixed forms of it. A text with no words (or null) has fingerprint zero."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    cols = [f"f{i}" for i in range(words)]

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf.t:
                h = shingle_hashes(t, ngram)
                rows.append([majority(h if i == 0 else mixed(h + np.uint64(i) * MIX)) if len(h) else 0 for i in range(words)])
            f = np.array(rows, np.uint64).reshape(-1, words).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "text_key": pdf.text_key, **{c: f[:, i] for i, c in enumerate(cols)}})

    return (
        docs.select(F.col(id_col).cast("string").alias("doc_id"), text_bytes(text_col).alias("t"))
        .withColumn("text_key", F.xxhash64("t"))
        .mapInPandas(run, "doc_id string, text_key long, " + ", ".join(f"{c} long" for c in cols))
        .select(F.col("doc_id").cast(kind).alias("doc_id"), "text_key", *cols)
    )


def _blocks(f: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """An order of the fingerprints by the counts of both halves of the first word, and blocks with their least and largest counts."""
    lo, hi = np.bitwise_count(f[:, 0] & np.uint64(0xFFFFFFFF)), np.bitwise_count(f[:, 0] >> np.uint64(32))
    order = np.lexsort((hi, lo))
    lo, hi = lo[order].astype(int), hi[order].astype(int)
    cuts = range(0, len(order), 512)
    return order, [(a, min(a + 512, len(order)), np.array([lo[a : a + 512].min(), lo[a : a + 512].max(), hi[a : a + 512].min(), hi[a : a + 512].max()])) for a in cuts]


def _forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """root with the links (a, b) merged in; root[i] is the smallest index of i's group."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def compare(left: np.ndarray, right: np.ndarray | None, radius: int, screen: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of left (and right, or left itself where that is None), as indices into both laid
    end to end. screen: how many bits of the first word may differ; radius: of all words."""
    f = left if right is None else np.concatenate([left, right])
    root = np.arange(len(f))
    (lo_order, lo_blocks), shift = _blocks(left), 0 if right is None else len(left)
    ro_order, ro_blocks = (lo_order, lo_blocks) if right is None else _blocks(right)
    r_sorted = (left if right is None else right)[ro_order]
    bounds = np.array([x[2] for x in ro_blocks])
    for i, (a, b, m) in enumerate(lo_blocks):
        gap = np.maximum(0, np.maximum(bounds[:, 0] - m[1], m[0] - bounds[:, 1])) + np.maximum(0, np.maximum(bounds[:, 2] - m[3], m[2] - bounds[:, 3]))
        x, xi = left[lo_order[a:b]], lo_order[a:b]
        for j in np.flatnonzero(gap <= screen):
            if right is None and j < i:
                continue
            c, d, _ = ro_blocks[j]
            near = np.bitwise_count(x[:, None, 0] ^ r_sorted[None, c:d, 0]) <= screen
            if not near.any():
                continue
            p, q = np.nonzero(near)
            p, q = xi[p], ro_order[c:d][q]
            if f.shape[1] > 1:
                ok = np.bitwise_count(left[p] ^ (left if right is None else right)[q]).sum(1, dtype=np.int64) <= radius
                p, q = p[ok], q[ok]
            root = _forest(len(f), p, q + shift, root)
    moved = np.flatnonzero(root != np.arange(len(f)))
    return moved, root[moved]


def links(prints: DataFrame, radius: int, screen: int | None = None) -> DataFrame:
    """(a, b): links that connect every two of the distinct fingerprints (node, f0, f1, ..) with at most `radius`
    differing bits. Beyond 64 bits, pairs are first screened by the first word: at most `screen` differing bits there."""
    spark = prints.sparkSession
    cols = [c for c in prints.columns if c != "node"]
    screen = radius if screen is None else screen
    ones = F.bit_count("f0")
    level = {r["p"]: r["n"] for r in prints.groupBy(ones.alias("p")).count().withColumnRenamed("count", "n").collect()}  # 65 rows at most
    total = sum(level.values())
    tiles = max(1, min(total, max(TILES, math.ceil(total / TILE))))
    # a fingerprint's tile: its rank by population count, drawn at random within its level
    before, spans, seen = {}, {}, 0
    for p in sorted(level):
        before[p], seen = seen, seen + level[p]
    per = total / tiles if total else 1
    tile_of = lambda rank: min(tiles - 1, int(rank / per))
    for p in sorted(level):
        for t in range(tile_of(before[p]), tile_of(before[p] + level[p] - 1) + 1):
            low, high = spans.get(t, (p, p))
            spans[t] = (min(low, p), max(high, p))
    if not level:
        return prints.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    # the counts of tiles grow with their numbers, so the tiles that one has to meet are a range: one row for each tile
    order, plan, first, last = sorted(spans), [], 0, 0
    for t in order:
        while spans[t][0] - spans[order[first]][1] > screen:
            first += 1
        while last + 1 < len(order) and spans[order[last + 1]][0] - spans[t][1] <= screen:
            last += 1
        plan.append((t, order[first], order[last]))
    lookup = F.create_map(*[x for p in sorted(level) for x in (F.lit(p), F.struct(F.lit(float(before[p])).alias("first"), F.lit(float(level[p])).alias("n")))])
    at = lookup[ones]
    draw = (F.xxhash64(*cols).bitwiseAND(F.lit(2**53 - 1)).cast("double") / F.lit(float(2**53)))
    tile = F.least(F.lit(tiles - 1), F.floor((at["first"] + F.floor(draw * at["n"])) / F.lit(per)).cast("int"))
    dealt = prints.withColumn("tile", tile).join(F.broadcast(spark.createDataFrame(plan, "tile int, first int, last int")), "tile")
    dealt = dealt.withColumn("other", F.explode(F.sequence("first", "last"))).select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).alias("side"), "node", *cols)

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"])
        f = np.ascontiguousarray(pdf[cols].to_numpy(np.int64)).view(np.uint64)
        n = int((~pdf.side).sum())
        node = pdf.node.to_numpy(np.int64)
        if pdf.i.iloc[0] != pdf.j.iloc[0]:
            if n == 0 or n == len(f):
                return pd.DataFrame({"a": node[:0], "b": node[:0]})
            i, j = compare(f[:n], f[n:], radius, screen)
        else:
            i, j = compare(f, None, radius, screen)
        return pd.DataFrame({"a": node[i], "b": node[j]})

    units = sum(b - a + 1 for _, a, b in plan)
    return dealt.repartition(max(shuffle_width(spark), min(4 * shuffle_width(spark), units)), "i", "j").groupBy("i", "j").applyInPandas(unit, "a long, b long")


def near_duplicates(docs: DataFrame, ngram: int = 3, words: int = 1, radius: int = 2, screen: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Groups of documents that are linked, directly or through others, by fingerprints with at most `radius` differing bits.

    Returns one row for each input row: doc_id, fingerprint (hexadecimal digits of all words), component_id (the smallest
    doc_id of its group, its own included), group_size, text_key (XXH64 of the text). Rows with equal fingerprints are always linked; so are all texts
    without words, null ones included. Rows that repeat are counted each. A row with a null doc_id takes part; its
    group's component_id is null only if no member has an id. A very long text is one fingerprint like any other. Other
    columns are not looked at, whatever their names. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, ngram, words, text_col, id_col))
    cols = [f"f{i}" for i in range(words)]
    key = F.col("f0") if words == 1 else F.xxhash64(*cols)
    prints = prints.withColumn("node", key)
    distinct = written(prints.groupBy("node", *cols).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    comp = components(links(distinct.select("node", *cols), radius, screen))
    rooted = written(distinct.join(comp, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root")))
    sums = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    where = written(hub_join(rooted, sums, "root").select("node", "component_id", "group_size").dropDuplicates(["node"]))
    digits = F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in cols])
    return hub_join(prints, where, "node").select("doc_id", digits.alias("fingerprint"), "component_id", "group_size", "text_key")
