"""Similarity join of documents by the Jaccard similarity of their sets of word n-grams, filtered by several global token orders.

Under any order of all tokens, two sets that are alike enough share a token among the first few of each (prefix filtering). So
sets are indexed by their prefixes under one order, and a pair is verified only if its prefixes meet under every other order
too: the filters are intersected, first by bit sets of the other orders' prefixes, which never lose a pair. All orders put
frequent tokens last, by classes of their exact number of texts, and differ in a hash inside a class.

Tokens are counted in bins: texts are taken in runs, a run sends each bin its tokens with the place of their text in the run, as one
row, and a bin sends back those that other texts have too. Tokens of one text only come first in every order, so most texts have no shared
token in their prefix and leave; of the others the shared tokens and the size of the set are all that a comparison needs.

Equal sets are one node. A group of nodes that share a prefix token is first compared with one leader, a star that grows
with the group, not with its square; the links found fuse the nodes into components. Only pairs of a group across two components
are then proposed, in chunks, with the size, position and order filters before the exact comparison: first one for each two
components, whose links fuse components again, and then all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import hub_join
from .common import MIX, components, mixed, shingle_sets, shuffle_width, small_batches, text_bytes, written

#: Tokens of a run and of a bin, about; texts of a run at most; bins at most.
RUN, BIN, RUN_TEXTS, BINS = 1_000_000, 1_000_000, 60_000, 65_536
#: A token in so many texts of one run is of the last class everywhere, and its texts are not sent to its bin.
HOT, LAST = 64, 255
#: Token orders besides the one that the index is by, and the bits of a prefix's bit set under each.
ORDERS, BITS = 2, 256
#: Bits of a node's whole set: each that another lacks is a token, at least, that it lacks.
WHOLE = 2_048
#: Nodes of a group of candidates that are compared at a time.
GROUP = 1_024
_SIG = [f"s{r}_{i}" for r in range(ORDERS) for i in range(BITS // 64)]


def set_key(h: np.ndarray) -> int:
    """A signed 64-bit key of a set: sets with equal keys count as equal."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 13)).view(np.int64))


def shared_least(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least number of tokens that a set of n shares with any set that is alike: percent of n, rounded up."""
    return -(-percent * n // 100)


def ordered(tokens: np.ndarray, level: np.ndarray, order: int, size: int) -> np.ndarray:
    """The first `size` tokens of the set under a global order: by their class, then by a hash of the order's own."""
    with np.errstate(over="ignore"):
        draw = mixed(tokens + np.uint64(order + 1) * MIX)
    return tokens[np.lexsort((draw, level))[:size]]


def pack48(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view("<u2").reshape(-1, 4)[:, 1:]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, 1:] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel()


def bit_set(tokens: np.ndarray, size: int = BITS) -> np.ndarray:
    """The tokens as a set of bits: two sets of tokens that meet have a common bit."""
    bits = np.zeros(size, np.uint8)
    bits[(mixed(tokens) % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def pack_places(at: np.ndarray) -> bytes:
    """Places in ascending order, as their small steps: the low bytes, then the high ones, which compress to little."""
    return np.diff(at, prepend=np.uint16(0)).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack_places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(2, -1).T).view("<u2").ravel(), dtype=np.uint16)


_PARTS = "kind int, bin int, run long, ids array<string>, keys binary, nodes binary, sizes binary, places binary, tokens binary, level binary"


def _parts(rows: int = 1, **cols) -> pd.DataFrame:
    """Rows of _PARTS: kind 0 is a run's texts, 1 tokens for a bin, 2 tokens for a bin that are hot, 3 shared tokens of a run's texts. Lists
    are columns, what is no list is the same in all rows."""
    names = [x.split(" ")[0] for x in _PARTS.split(", ")]
    value = lambda c: cols[c] if isinstance(cols.get(c), list) else [cols.get(c)] * rows
    return pd.DataFrame({c: pd.Series(value(c), dtype=object) for c in names}).astype({"kind": "int32", "bin": "int32", "run": "int64"})


def _runs(docs: DataFrame, ngram: int, bins: int, text_col: str, id_col: str) -> DataFrame:
    """The runs of texts and their tokens by bin. Equal sets of a run are one place in it."""
    small_batches(docs.sparkSession)
    most, texts_most, hot_from = RUN, RUN_TEXTS, HOT

    def close(run: int, ids: list, keys: list[int], places: list[int], nodes: dict[int, int], sizes: list[int], sets: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        own = run % bins
        raw = lambda x, kind: np.array(x, kind).tobytes()
        yield _parts(kind=0, bin=own, run=run, ids=[ids], keys=raw(keys, np.int64), nodes=raw(list(nodes), np.int64), sizes=raw(sizes, np.int64), places=raw(places, np.int32))
        h = np.concatenate([np.empty(0, np.uint64), *sets])
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets]).astype(np.uint16)
        bin_of = ((h & np.uint64(0xFFFF)) % np.uint64(bins)).astype(np.uint16)
        hot = np.zeros(len(h), bool)
        if len(sets) >= hot_from:
            order = np.argsort(h)
            first = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
            n = np.diff(np.r_[first, len(h)])
            hot[order] = np.repeat(n >= hot_from, n)
        if hot.any():
            yield _parts(kind=3, bin=own, run=run, places=pack_places(at[hot]), tokens=_named(h[hot], bin_of[hot]).tobytes(), level=np.full(hot.sum(), LAST, np.uint8).tobytes())
        order = np.argsort(bin_of, kind="stable")  # places go up in each bin
        order = order[~hot[order]]
        edges = np.searchsorted(bin_of[order], np.arange(bins + 1))
        full = np.flatnonzero(np.diff(edges)).tolist()
        if full:
            tokens, places = pack48(h[order]), at[order]
            ends = [(edges[b], edges[b + 1]) for b in full]
            yield _parts(len(full), kind=1, bin=full, run=run, places=[pack_places(places[a:b]) for a, b in ends], tokens=[tokens[6 * a : 6 * b] for a, b in ends])
        for b in np.unique(bin_of[hot]).tolist():
            yield _parts(kind=2, bin=b, run=run, tokens=pack48(np.unique(h[hot & (bin_of == b)])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 24, 0
        ids, keys, places, nodes, sizes, sets = [], [], [], {}, [], []
        for pdf in batches:
            for d, k, h in zip(pdf.doc_id, pdf.text_key, shingle_sets(pdf.t, ngram), strict=True):
                ids.append(d)
                keys.append(k)
                if not len(h):
                    places.append(-1)
                    continue
                node = set_key(h)
                if node not in nodes:
                    nodes[node] = len(nodes)
                    sizes.append(len(h))
                    sets.append(h)
                    held += len(h)
                places.append(nodes[node])
                if held >= most or len(ids) >= texts_most:
                    yield from close(number, ids, keys, places, nodes, sizes, sets)
                    number, held = number + 1, 0
                    ids, keys, places, nodes, sizes, sets = [], [], [], {}, [], []
        if ids:
            yield from close(number, ids, keys, places, nodes, sizes, sets)

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), text_bytes(text_col).alias("t")).withColumn("text_key", F.xxhash64("t")).mapInPandas(run, _PARTS)


def _named(h: np.ndarray, bin_of: np.ndarray | int) -> np.ndarray:
    """A token as one number: the upper 48 bits of its hash, and its bin."""
    return (h & ~np.uint64(0xFFFF)) | np.asarray(bin_of).astype(np.uint64)


def _counted(parts: DataFrame) -> DataFrame:
    """Of each bin the shared tokens, with their classes, back to the runs (kind 3); rows of kinds 0 and 3 pass. A token that very many texts
    have is hot, and comes once from each run."""

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.kind == 1]
        hot = np.unique(unpack48(b"".join(pdf.tokens[pdf.kind == 2])))
        h = unpack48(b"".join(own.tokens))
        order = np.argsort(h)
        first = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0]) if len(h) else order
        n = np.diff(np.r_[first, len(h)])
        class_of = np.where(np.isin(h[order[first]], hot), LAST, np.minimum(np.frexp(n.astype(float))[1], LAST - 1)).astype(np.uint8)
        class_of[(n == 1) & (class_of != LAST)] = 0
        level = np.empty(len(h), np.uint8)
        level[order] = np.repeat(class_of, n)
        back = []
        for run, places, (a, b) in zip(own.run, own.places, pairwise(accumulate((len(t) // 6 for t in own.tokens), initial=0)), strict=True):
            here = np.flatnonzero(level[a:b])
            if len(here):
                back.append((run, pack_places(unpack_places(places)[here]), _named(h[a:b][here], key[0]).tobytes(), level[a:b][here].tobytes()))
        run, places, tokens, levels = map(list, zip(*back, strict=True)) if back else ([], [], [], [])
        return pd.concat([pdf[pdf.kind.isin([0, 3])], _parts(len(back), kind=3, bin=key[0], run=run, places=places, tokens=tokens, level=levels)])

    return parts.groupBy("bin").applyInPandas(count, _PARTS)


def _nodes(parts: DataFrame, percent: int) -> DataFrame:
    """(node, n, own, prefix, h, bits, bit sets of the other orders' prefixes) of the nodes that have a shared token in their prefix: the
    size of the set, the number of its own tokens, which come first, and its shared ones, whole and as bits."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf[pdf.kind == 0].iloc[0]
        node, size = np.frombuffer(table.nodes, np.int64), np.frombuffer(table.sizes, np.int64)
        back = pdf[pdf.kind == 3]
        at = np.concatenate([np.empty(0, np.uint16), *map(unpack_places, back.places)])
        token, level = (np.frombuffer(b"".join(back[c]), t) for c, t in (("tokens", np.uint64), ("level", np.uint8)))
        order = np.argsort(at, kind="stable")
        at, token, level = at[order], token[order], level[order]
        cuts = np.searchsorted(at, np.arange(len(node) + 1))
        own = size - np.diff(cuts)
        wanted = len_prefix(size, percent) - own
        rows = []
        for i in np.flatnonzero(wanted > 0).tolist():
            t, lv = token[cuts[i] : cuts[i + 1]], level[cuts[i] : cuts[i + 1]]
            sig = np.concatenate([bit_set(ordered(t, lv, r + 1, wanted[i])) for r in range(ORDERS)])
            rows.append((node[i], size[i], own[i], ordered(t, lv, 0, wanted[i]).tobytes(), np.sort(t).tobytes(), bit_set(t, WHOLE).tobytes(), *sig.tolist()))
        return pd.DataFrame(rows, columns=["node", "n", "own", "prefix", "h", "bits", *_SIG])

    return parts.groupBy("run").applyInPandas(gather, "node long, n long, own long, prefix binary, h binary, bits binary, " + ", ".join(f"{c} long" for c in _SIG)).dropDuplicates(["node"])


def len_prefix(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - shared_least(n, percent) + 1


def _index(nodes: DataFrame) -> DataFrame:
    """(token, node, n, pos): the shared tokens of each prefix and their places under the first order."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [np.frombuffer(p, np.int64) for p in pdf.prefix]
            n = [len(t) for t in tokens]
            if sum(n):
                yield pd.DataFrame({"token": np.concatenate(tokens), "node": np.repeat(pdf.node.to_numpy(), n), "n": np.repeat(pdf.n.to_numpy(), n), "pos": np.concatenate([o + np.arange(m) for o, m in zip(pdf.own, n, strict=True)])})

    return nodes.select("node", "n", "own", "prefix").mapInPandas(spread, "token long, node long, n long, pos long")


def _rows(parts: DataFrame, kind: str) -> DataFrame:
    """(doc_id, text_key, node, n) of every text, node being null for an empty set."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, keys, nodes, sizes, places in zip(pdf.ids, pdf["keys"], pdf.nodes, pdf.sizes, pdf.places, strict=True):
                at = np.frombuffer(places, np.int32)
                node, size = np.r_[np.frombuffer(nodes, np.int64), 0], np.r_[np.frombuffer(sizes, np.int64), 0]
                out = pd.DataFrame({"doc_id": list(ids), "text_key": np.frombuffer(keys, np.int64), "node": pd.array(node[at], "Int64").copy(), "n": size[at]})
                yield out.assign(node=out.node.where(at >= 0))

    found = parts.where("kind = 0").select("ids", "keys", "nodes", "sizes", "places").mapInPandas(spread, "doc_id string, text_key long, node long, n long")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def _may(n: np.ndarray, own: np.ndarray, sig: np.ndarray, bits: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int, pos: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows p and q that the size, position and order filters and the bound that the bits of both sets give on what they share
    leave. pos: the place of a token that both have; what they share before it does not count."""
    least = -(-percent * (n[p] + n[q]) // (100 + percent))  # shared tokens, of a pair that is alike
    keep = least <= np.minimum(n[p], n[q])
    if pos is not None:
        keep &= np.minimum(n[p] - pos[p], n[q] - pos[q]) >= least  # what may follow the first shared token, itself included
    p, q, least = p[keep], q[keep], least[keep]
    keep = ((sig[p] & sig[q]) != 0).any(2).all(1)
    p, q, least = p[keep], q[keep], least[keep]
    both = bits[p] & bits[q]
    lacks = [np.bitwise_count(bits[x] ^ both).sum(1, dtype=np.int64) for x in (p, q)]
    keep = np.minimum(n[p] - own[p] - lacks[0], n[q] - own[q] - lacks[1]) >= least
    return p[keep], q[keep]


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """n, own, the bit sets of the other orders and the bits of the shared tokens."""
    return rows.n.to_numpy(), rows.own.to_numpy(), rows[_SIG].to_numpy(np.int64).reshape(len(rows), ORDERS, -1), np.frombuffer(b"".join(rows.bits), np.uint64).reshape(len(rows), -1)


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the filters leave. A node a may have very many partners: it comes to them by hub_join."""
    cols = ["n", "own", "bits", *_SIG]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sides = pd.concat([pdf[[f"{s}_{c}" for c in cols]].set_axis(cols, axis=1) for s in ("x", "y")])
            p, _ = _may(*_arrays(sides), np.arange(len(pdf)), len(pdf) + np.arange(len(pdf)), percent)
            yield pdf.iloc[p][["a", "b"]]

    side = lambda key, s: sets.select(F.col("node").alias(key), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    return hub_join(pairs, side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, n, h) are alike: shared * 100 >= percent * all. Sets are compared exactly, one pair after another.
    A node a may have very many partners: it comes to them by hub_join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y, m, n in zip(pdf.x, pdf.y, pdf.na, pdf.nb, strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                both = int((both[1:] == both[:-1]).sum())
                ok.append(100 * both >= percent * (m + n - both))
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    left = hub_join(pairs, sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("h").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("h").alias("y")), "b")
    return both.select("a", "b", "x", "y", "na", "nb").mapInPandas(run, "a long, b long")


def _across(index: DataFrame, percent: int, one: bool = False) -> DataFrame:
    """(a, b): pairs of nodes of two components that share a token of the index (token, node, n, pos, comp, own, bits, bit sets) and
    pass the size, position and order filters and the bound that the bits of both sets give on what they share. A large group is dealt
    into chunks, and each pair of chunks is one unit of work. one: a unit gives one pair only for each two components, of nearly equal size."""
    spark = index.sparkSession
    sizes = index.groupBy("token").agg(F.count("*").alias("m"))
    k = F.ceil(F.col("m") / GROUP).cast("int")
    dealt = hub_join(index, sizes, "token").withColumn("k", k)
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("k")).cast("int")
    dealt = dealt.withColumn("chunk", chunk).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    bins = 4 * shuffle_width(spark)  # small groups share a unit
    dealt = dealt.withColumn("bin", F.when(F.col("k") > 1, F.col("token")).otherwise(F.pmod(F.xxhash64("token"), F.lit(bins))))
    dealt = dealt.select("bin", (F.col("k") > 1).alias("big"), F.least("chunk", "x").alias("i"), F.greatest("chunk", "x").alias("j"), "chunk", "token", "node", "n", "pos", "comp", "own", "bits", *_SIG)

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:  # its pairs fit in memory: a unit holds GROUP rows of a token or a share of the small groups
        pdf = pdf.sort_values(["token", "node"])
        token, node, pos, comp, chunk = (pdf[c].to_numpy() for c in ("token", "node", "pos", "comp", "chunk"))
        sides, i, j = _arrays(pdf), pdf.i.iloc[0], pdf.j.iloc[0]
        cuts = np.r_[0, np.flatnonzero(token[1:] != token[:-1]) + 1, len(token)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for c in range(a, b, 256):  # rows at a time
                p, q = np.nonzero(comp[c : min(c + 256, b), None] != comp[None, a:b])
                p, q = p + c, q + a
                keep = (node[p] < node[q]) & ((chunk[p] != chunk[q]) | (i == j))
                out.append(np.stack(_may(*sides, p[keep], q[keep], percent, pos)))
        p, q = np.concatenate([np.empty((2, 0), np.int64), *out], 1)
        if one:
            x, y = np.minimum(comp[p], comp[q]), np.maximum(comp[p], comp[q])
            order = np.lexsort((np.abs(sides[0][p] - sides[0][q]), y, x))
            p, q = (a[order][np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)][: len(p)]] for a in (p, q))
        ab = np.unique(np.stack([node[p], node[q]]), axis=1)
        return pd.DataFrame({"a": ab[0], "b": ab[1]})

    return dealt.groupBy("bin", "big", "i", "j").applyInPandas(unit, "a long, b long").distinct()


def linked(docs: DataFrame, ngram: int, percent: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, n, root) of every row: the XXH64 of its text, the size of its set of n-grams, and a number that the rows have in
    common that links of `percent` per cent or more connect; null for an empty set."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bins = int(min(BINS, max(shuffle_width(spark), size // (6 * BIN))))  # a word and a space are some six bytes
    parts = written(_counted(_runs(docs, ngram, bins, text_col, id_col)))
    rows = _rows(parts, docs.schema[id_col].dataType.simpleString())
    sets = written(_nodes(parts, percent))
    index = _index(sets)
    shared = index.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    index = written(hub_join(index, shared.select("token"), "token", "left_semi"))

    leader = index.groupBy("token").agg(F.min(F.struct("n", "node")).alias("l")).select("token", F.col("l.node").alias("a"))
    star = written(hub_join(index, leader, "token").select("a", F.col("node").alias("b")).where("a <> b").distinct())
    links = written(verified(written(likely(star, sets, percent)), sets, percent))
    tried = written(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    comp = written(components(links))
    for one in (True, False):  # a pair of components that one pair links is one component before all other pairs are looked at
        own = written(hub_join(index, comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"))
        wide = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        wide = written(hub_join(own, wide, "token", "left_semi").join(sets.select("node", "own", "bits", *_SIG), "node"))
        rest = written(_across(wide, percent, one).join(tried, ["a", "b"], "left_anti"))
        found = written(verified(rest, sets, percent))
        tried = tried.union(rest)
        if not found.isEmpty():
            links = links.union(found)
            comp = written(components(links))
    whole = hub_join(rows.where("node IS NOT NULL"), comp, "node", "left").select("doc_id", "text_key", "n", F.coalesce("root", "node").alias("root"))
    return written(whole.union(rows.where("node IS NULL").select("doc_id", "text_key", "n", "node")))


def similar_documents(docs: DataFrame, ngram: int = 4, percent: int = 85, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each input row: documents link when their sets of word n-grams have a Jaccard
    similarity of `percent` per cent or more, and component_id is the smallest doc_id that links reach, the own one included.

    Words are what ASCII white space separates, A-Z lower-cased; texts are read whole. A text with fewer words than `ngram` is one
    n-gram. Null texts and texts without words have none and link with nothing, not even with each other. Equal sets, and so rows that
    repeat, always link. A row with a null id takes part; its group's component_id is null only if no member has an id. Sets are
    compared by hashes of their n-grams (48 bits and those that choose the bin) and known by a 64-bit key. Other columns are not looked at. An empty table gives no rows.
    """
    rows = linked(docs, ngram, percent, text_col, id_col).withColumnRenamed("n", "n_shingles")
    rooted = rows.where("root IS NOT NULL")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = rows.where("root IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return hub_join(rooted, least, "root").select("doc_id", "n_shingles", "component_id").union(own)


def near_copies(docs: DataFrame, ngram: int, percent: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_key): the row that stays of each group of documents that similarities of `percent` per cent or more between their
    sets of n-grams connect: the smallest doc_id, null ones last, then the smallest text_key (XXH64 of the text).

    A text with fewer words than `ngram` is one n-gram; texts without words (or null) are alike. Rows that repeat in id and
    text stay as one row here. Other columns are not looked at. An empty table gives no rows.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    return linked(docs, ngram, percent, text_col, id_col).groupBy("root").agg(F.min(first).alias("first")).select("first.doc_id", "first.text_key")
