"""Hard-negative mining by shared lists of anchor clusters, in the manner of MAXIMUS.

Anchors are clustered by direction. For a cluster with centre c whose members lie within the angle b of it, a row x can score at
most |a| |x| cos(max(0, angle(x, c) - b)) with a member a. Each cluster sorts a block of rows by that bound once, and every
member walks the sorted list until the bound of what is left shows that nothing there can enter its result: the answer is
exact. Rows are dealt into blocks by a hash of their ids, anchors into chunks; a unit of work is one chunk over one block and
holds no more than that. Each unit gives the best few of its block, and the best of all blocks are ranked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, written

#: Rows of a block and anchors of a chunk, about; clusters at most, and the anchors (drawn by a hash) that their centres are fitted on, at most.
BLOCK, CHUNK = 16_384, 2_048
CLUSTERS, SAMPLE = 16, 4_096
#: Added to angles, so that rounding never makes a bound too small.
SLACK = 1e-6
_FIRST, _LARGEST = 256, 2_048


def usable_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): rows whose id, label, vector and components are all there and finite. Rows that share an id count once: that of the
    least label, then the least vector."""
    x = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    return x.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def matrix(vectors, scale: float, width: int) -> np.ndarray:
    """floor(scale * component) of each vector; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths); a zero vector stays zero."""
    n = np.sqrt((x * x).sum(1))
    return x / np.where(n > 0, n, 1)[:, None], n


def fit_centres(x: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means over the rows of x; an empty cluster keeps its centre."""
    unit, _ = directions(x)
    centres = unit[np.linspace(0, len(unit) - 1, min(clusters, len(unit))).astype(int)] if len(unit) else unit
    for _ in range(rounds):
        at = (unit @ centres.T).argmax(1) if len(centres) else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, unit)
        new, n = directions(sums)
        centres = np.where((n > 0)[:, None], new, centres)
    return centres


def angles(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centre, -1, 1))


def walk(a: np.ndarray, a_id: np.ndarray, a_label: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, centres: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, window, row, score) of the k best rows of x for each anchor and window: rows of the anchor's label (same) or of
    others, not of its own id, with low[anchor, window] <= score <= high[anchor, window]; ties by the smaller id."""
    x_unit, x_len = directions(x)
    a_unit, a_len = directions(a)
    group = (a_unit @ centres.T).argmax(1) if len(centres) else np.zeros(len(a), int)
    found = []
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        centre = directions(a_unit[own].sum(0, keepdims=True))[0][0]
        if not centre.any():
            centre = np.eye(1, a.shape[1])[0]
        reach = angles(a_unit[own], centre).max() + SLACK
        bound = x_len * np.cos(np.clip(angles(x_unit, centre) - reach, 0, None))
        order = np.argsort(-bound, kind="stable")
        found += _members(own, order, bound[order], a, a_len, a_id, a_label, x, x_id, x_label, low, high, k, same)
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64 if i < 3 else float) for i in range(4))


def _members(own, order, bound, a, a_len, a_id, a_label, x, x_id, x_label, low, high, k, same) -> list[tuple[np.ndarray, ...]]:
    windows = low.shape[1]
    need = low[own].copy()  # a row has to score as much, to enter
    best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for _ in range(windows)]  # member, row, score
    live, start, step = np.arange(len(own)), 0, _FIRST
    while start < len(order):
        most = a_len[own[live]] * (bound[start] + 1e-9 * abs(bound[start])) + SLACK
        live = live[most >= need[live].min(1)]  # the others' results are certain
        if not len(live):
            break
        at = order[start : start + step]
        score = a[own[live]] @ x[at].T
        fits = (a_label[own[live]][:, None] == x_label[at]) == same
        fits &= a_id[own[live]][:, None] != x_id[at]
        for w in range(windows):
            p, q = np.nonzero(fits & (score >= need[live, w][:, None]) & (score <= high[own[live], w][:, None]))
            if not len(p):
                continue
            member, row, s = (np.concatenate(z) for z in zip(best[w], (live[p], at[q], score[p, q]), strict=True))
            rank = np.lexsort((x_id[row], -s, member))
            member, row, s = member[rank], row[rank], s[rank]
            first = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])
            place = np.arange(len(member)) - np.repeat(first, np.diff(np.r_[first, len(member)]))
            kept = place < k
            best[w] = member, row, s = member[kept], row[kept], s[kept]
            full = place[kept] == k - 1
            need[member[full], w] = np.maximum(need[member[full], w], s[full])
        start, step = start + step, min(2 * step, _LARGEST)
    return [(own[m], np.full(len(m), w), r, s) for w, (m, r, s) in enumerate(best)]


def walk_exactly(a, a_id, a_label, x, x_id, x_label, low, high, k, same) -> tuple[list, ...]:
    """walk() in whole numbers of any size, row by row: for vectors whose products could pass what a double holds exactly."""
    big, out = [[int(c) for c in r] for r in x], []
    for i, r in enumerate(a):
        r = [int(c) for c in r]
        scored = sorted((-sum(c * d for c, d in zip(r, y, strict=True)), x_id[j], j) for j, y in enumerate(big) if (a_label[i] == x_label[j]) == same and a_id[i] != x_id[j])
        for w in range(len(low[i])):
            out += [(i, w, j, -s) for s, _, j in [z for z in scored if low[i][w] <= -z[0] <= high[i][w]][:k]]
    return tuple([r[i] for r in out] for i in range(4))


def _long(s: int) -> int:
    return max(-(2**63), min(2**63 - 1, int(s)))


def _search(anchors: DataFrame, rows: DataFrame, blocks: int, chunks: int, scale: float, centres: np.ndarray, k: int, same: bool, share: tuple[int, int]) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score): the best k rows of each block for each anchor (id, label, v) and, unless
    `same`, each of its positives (p: array of (id, score))."""

    def unit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["anchor_id", "positive_id", "positive_score", "id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=cols)
        width = max(map(len, [*left.v, *right.v]))
        a, x = matrix(left.v, scale, max(width, 1)), matrix(right.v, scale, max(width, 1))
        ids, own = [z.id.to_numpy(np.int64) for z in (left, right)], [z.label.to_numpy() for z in (left, right)]
        given = [[(None, 0)] for _ in range(len(left))] if same else [[(p["id"], p["score"]) for p in ps] for ps in left.p]
        n = max(map(len, given))
        span = lambda s: (-math.inf, math.inf) if same else (-(-share[0] * s // 100), share[1] * s // 100)
        bounds = [[*map(span, (s for _, s in g)), *[(math.inf, -math.inf)] * (n - len(g))] for g in given]
        if np.sqrt((a * a).sum(1)).max() * np.sqrt((x * x).sum(1)).max() < 2**52:
            low, high = np.array(bounds, float).transpose(2, 0, 1)
            wide = np.zeros((len(centres), a.shape[1]))
            wide[:, : centres.shape[1]] = centres[:, : a.shape[1]]
            i, w, j, s = walk(a, ids[0], own[0], x, ids[1], own[1], low, high, k, same, wide)
        else:
            i, w, j, s = walk_exactly(a, ids[0], own[0], x, ids[1], own[1], [[b[0] for b in r] for r in bounds], [[b[1] for b in r] for r in bounds], k, same)
        return pd.DataFrame({"anchor_id": ids[0][np.asarray(i, int)], "positive_id": pd.array([given[p][q][0] for p, q in zip(i, w, strict=True)], "Int64"), "positive_score": [given[p][q][1] for p, q in zip(i, w, strict=True)], "id": ids[1][np.asarray(j, int)], "score": [_long(z) for z in s]}, columns=cols)

    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "id"), F.lit(chunks)).cast("int")
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int")
    left = anchors.withColumn("i", chunk).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("j", block).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(unit, "anchor_id long, positive_id long, positive_score long, id long, score long")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`. Scores are inner products of floor(scale * component), whole numbers. An
    anchor's positives are the `positives` best other rows of its label; for each, the `negatives` best rows of other labels whose
    score lies within low and high per cent of the positive's are returned, ranked from 1; ties by the smaller id.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Rows that share an id count
    once (the least label, then the least vector). Vectors of different lengths are compared as if the shorter ended in zeros; an
    empty one scores 0. Scores are exact up to 64 bits; larger ones count as the largest (smallest) long where positives give the limits. A positive
    without negatives has no row; nor has one whose score is below zero. An empty table gives none. Other columns are not looked at.
    """
    spark = rows.sparkSession
    used = written(usable_rows(rows, id_col, vector_col, label_col))
    anchors = written(used.where(F.col("id") % every == 0))
    total, n = used.count(), anchors.count()
    blocks, chunks = max(1, math.ceil(total / BLOCK), min(shuffle_width(spark), total // 1024)), max(1, math.ceil(n / CHUNK))
    drawn = [r["v"] for r in anchors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    centres = fit_centres(matrix(drawn, scale, max(map(len, drawn), default=1) or 1), CLUSTERS)
    near = _best(_search(anchors, used, blocks, chunks, scale, centres, positives, True, (low, high)), ["anchor_id"], positives)
    near = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("p")).withColumnRenamed("anchor_id", "id")
    asked = written(anchors.join(near, "id"))
    found = _search(asked, used, blocks, chunks, scale, centres, negatives, False, (low, high))
    return _best(found, ["anchor_id", "positive_id"], negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
