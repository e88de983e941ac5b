"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

A window has as many words as the benchmark item it is compared with (or is the whole document, if that is shorter).
Windows and items have 64-bit SimHash fingerprints of their weighted shingles. A multi-index over m blocks of the
fingerprint finds all items within the radius r: two such fingerprints differ in at most r // m bits of some block. For
each block there is a table from the block's value to the items (as a bit set) whose block lies within that many bits, so
a window looks m sets up and joins them; no window is compared with items outside them. Candidates are then verified by
the exact weighted Jaccard similarity of the shingles. Windows that hold no shingle of any item have similarity zero, so
only the neighbourhood of shared shingles is fingerprinted.

The documents are never shuffled: every task has the index. A benchmark of up to PART items and PART_CHARS characters is
one index and one scan of the documents; a larger one is cut into parts of that size, each with a scan of its own, and
the driver holds one part at a time.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, small_batches

#: Most items, and characters, of a part of the benchmark that is sent to every task.
PART, PART_CHARS = 50_000, 20_000_000
#: Bits by which a window's fingerprint may differ from an item's, and blocks of the multi-index. Of pairs that are 0.8
#: alike, fingerprints differ in 10 bits of 64 on average (standard deviation 3). With blocks of 7 bits that may differ in
#: one, chance puts 0.43 of the items among the candidates; a radius that finds 0.8 leaves no more to gain.
RADIUS, BLOCKS = 17, 9
_WORD = re.compile(r"[^\W_]+")


_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> np.ndarray:
    """Hashes of the words: runs of letters and digits of the lower-cased text."""
    low = text.lower()
    if low.isascii() or all(c.isalnum() for c in set(low) if c > "\x7f"):  # then only ASCII characters cut words
        w = low.encode("utf-8", "surrogatepass").translate(_SPACED).split()
    else:
        w = [x.encode("utf-8", "surrogatepass") for x in _WORD.findall(low)]
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; of all words, where there are fewer."""
    n = max(1, min(n, len(ids)))
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(h)])
    return h


def signs(h: np.ndarray) -> np.ndarray:
    """Each hash as 64 values of +1 or -1."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Index:
    """The items of one part of the benchmark: shingles, fingerprints and the multi-index, by number of words."""

    def __init__(self, items: list[tuple[str, str]], ngram: int, radius: int, blocks: int):
        self.ngram, self.radius, self.blocks = ngram, radius, blocks
        self.items, by_size, prints_, known = [], defaultdict(list), [], []
        for item, text in items:
            ids = words_of(text)
            if not len(ids):
                continue
            h = shingles(ids, ngram)
            by_size[len(ids)].append(len(self.items))
            self.items.append((item, *np.unique(h, return_counts=True)))
            prints_.append(prints(signs(h).sum(0, keepdims=True))[0])
            known.append(self.items[-1][1])
        self.prints = np.array(prints_, np.uint64)
        self.known = np.unique(np.concatenate(known)) if known else np.empty(0, np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        edges = [64 * b // blocks for b in range(blocks + 1)]
        self.cuts = list(zip(edges[:-1], np.diff(edges).tolist(), strict=True))  # first bit and width of each block
        self.tables = {size: (np.array(which), self._table(self.prints[which])) for size, which in by_size.items()}

    def _block(self, f: np.ndarray, b: int) -> np.ndarray:
        first, width = self.cuts[b]
        return ((f >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def _table(self, own: np.ndarray) -> list[np.ndarray]:
        """For each block and value, the items whose block differs from it in radius // blocks bits or fewer, eight a byte."""
        out, item = [], np.arange(len(own))
        for b, (_, width) in enumerate(self.cuts):
            table = np.zeros((1 << width, -(-len(own) // 8)), np.uint8)
            value = self._block(own, b)
            for flip in np.flatnonzero(np.bitwise_count(np.arange(1 << width)) <= self.radius // self.blocks):
                np.bitwise_or.at(table, (value ^ flip, item // 8), (1 << item % 8).astype(np.uint8))
            out.append(table)
        return out

    def near(self, size: int, f: np.ndarray) -> list[tuple[int, int]]:
        """(row of f, item) for all items of this number of words within the radius."""
        which, tables = self.tables[size]
        sets = tables[0][self._block(f, 0)]
        for b in range(1, self.blocks):
            sets |= tables[b][self._block(f, b)]
        r, c = np.nonzero(np.unpackbits(sets, axis=1, count=len(which), bitorder="little"))
        ok = np.bitwise_count(f[r] ^ self.prints[which[c]]) <= self.radius
        return list(zip(r[ok].tolist(), which[c[ok]].tolist(), strict=True))

    def matches(self, ids: np.ndarray, least: float) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, differing bits) of each item's best window in the document."""
        best: dict[int, tuple] = {}
        whole = shingles(ids, self.ngram)
        spots = self._hits(whole)
        for size in self.tables:
            n = min(self.ngram, size)
            h, at = (whole, spots) if n == self.ngram else ((x := shingles(ids, n)), self._hits(x))
            if not len(at):
                continue
            wide, last = max(1, min(size, len(ids)) - n + 1), max(0, len(ids) - size)
            mark = np.zeros(last + 2, np.int64)
            np.add.at(mark, np.clip(at - wide + 1, 0, last), 1)
            np.add.at(mark, np.clip(at, 0, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
            low = int(starts[0])
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for cut in range(0, len(run), 4096):
                    part = run[cut : cut + 4096]
                    low = int(part[0])
                    total = np.cumsum(np.vstack([np.zeros((1, 64), np.int32), signs(np.ascontiguousarray(h[low : part[-1] + wide]))]), 0)
                    f = prints(total[part - low + wide] - total[part - low])
                    for r, i in self.near(size, f):
                        s = int(part[r])
                        if (sim := self._similarity(h[s : s + wide], i)) >= least and (i not in best or sim > best[i][3]):
                            best[i] = (self.items[i][0], s, min(size, len(ids)), sim, int(f[r] ^ self.prints[i]).bit_count())
        return list(best.values())

    def _hits(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.filter[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        return at[self.known[place] == h[at]]

    def _similarity(self, window: np.ndarray, i: int) -> float:
        _, h, n = self.items[i]
        own, m = np.unique(window, return_counts=True)
        place = np.minimum(np.searchsorted(h, own), len(h) - 1)
        both = int(np.minimum(m, np.where(h[place] == own, n[place], 0)).sum())
        return both / (len(window) + int(n.sum()) - both)


_INDEX: dict[str, Index] = {}


def _index(key: str, sent, *rule: int) -> Index:
    """The index of a part, built once in each Python worker."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Index(sent.value, *rule)
    return _INDEX[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, ngram: int = 5, least: float = 0.8, radius: int = RADIUS, blocks: int = BLOCKS, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, distance, text_key): for each document and benchmark item, its best window
    where the weighted Jaccard similarity of the shingles of `ngram` words is `least` or more (earliest, if several).

    Words are runs of letters and digits, lower-cased. Items with fewer words than `ngram` are compared as whole
    sequences. Null and empty texts and items without words match nothing. Rows that repeat are reported each. Very long
    texts are read whole. Other columns are not looked at, whatever their names. An empty table on either side gives no
    rows. Candidates come from fingerprints within `radius`: a window that is alike may, rarely, lie beyond it; equal
    passages never do.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    source = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col).cast("binary")).alias("text_key")).where(F.length("text") > 0)
    schema = "doc_id string, text_key long, item_id string, start_word long, n_words long, similarity double, distance int"
    out = None

    def scan(part: list[tuple[str, str]]) -> DataFrame:
        sent, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches):
            index = _index(name, sent, ngram, radius, blocks)
            for pdf in batches:
                rows = [(d, k, *m) for d, k, t in zip(pdf.doc_id, pdf.text_key, pdf.text, strict=True) for m in index.matches(words_of(t), least)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "text_key", "item_id", "start_word", "n_words", "similarity", "distance"])

        return source.mapInPandas(run, schema)

    part, chars = [], 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0).toLocalIterator():
        part.append((r["i"], r["t"]))
        chars += len(r["t"])
        if len(part) >= PART or chars >= PART_CHARS:
            out, part, chars = scan(part) if out is None else out.union(scan(part)), [], 0
    if part or out is None:
        out = scan(part) if out is None else out.union(scan(part))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("item_id").cast(item_kind).alias("item_id"), "start_word", "n_words", "similarity", "distance", "text_key")
