"""Removal of passages that occur more than once, found through difference-cover anchors.

Positions that lie in a difference cover D modulo v are sampled: for any two positions i and j there is a shift k < v
with both i + k and j + k in the cover. Two equal windows of `window` words therefore share an anchor of
window - v + 1 words at an aligned cover position. Only anchors are compared first; the windows around anchors that
repeat are then extended to the full length and compared by 96 bits.

Hashes travel in blobs, one for each bin and flush of a task. A task sends each hash once and settles its own repeats
itself, so a passage that a third of all documents hold costs a bin one entry for each flush, not one for each copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, mixed, rolling, row_key, shuffle_width, small_batches, text_bytes, word_hashes

#: Perfect difference sets: every residue modulo v is the difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Entries of a task's flush, and of a bin on average; and bins that a flush is dealt into, at most: beyond that there are
#: two levels, so that a blob always holds hundreds of entries.
FLUSH, BIN, COARSE = 1_000_000, 500_000, 2048
_NAMES = ["bin", "docs", "doc", "pos", "h1", "h2", "settled"]
_BLOB = "bin int, docs binary, doc binary, pos binary, h1 binary, h2 binary, settled boolean"


def cover_for(window: int) -> tuple[int, np.ndarray]:
    """The largest period that leaves anchors of at least 12 words (or, for short windows, of one word)."""
    fit = [v for v in COVERS if window - v + 1 >= 12] or [v for v in COVERS if window - v + 1 >= 1]
    v = max(fit) if window >= 18 else (min(fit) if fit else 1)
    member = np.zeros(v, bool)
    member[list(COVERS[v]) if v > 1 else [0]] = True
    return v, member


def _planes(x: np.ndarray) -> bytes:
    """The array's bytes, all lowest ones first: the high bytes of small numbers then compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def _bin_of(h: np.ndarray, bins: int) -> np.ndarray:
    """Bins are ranges of hashes."""
    return (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)


def _entries(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Of blobs that are not settled: h1, h2, pos, the documents' keys, and for each entry its key's place (-1: none)."""
    h1 = np.concatenate([np.cumsum(_unplanes(x, np.uint64), dtype=np.uint64) for x in rows.h1])
    h2 = np.concatenate([_unplanes(x, np.uint32) for x in rows.h2])
    pos = np.concatenate([_unplanes(x, np.uint32) for x in rows.pos])
    keys, base, doc = [], 0, []
    for d, t in zip(rows.doc, rows.docs, strict=True):
        d, t = _unplanes(d, np.uint32).astype(np.int64), np.frombuffer(t, np.int64)
        doc.append(np.where(d == 0, -1, d - 1 + base))
        keys.append(t)
        base += len(t)
    return h1, h2, pos, np.concatenate(keys), np.concatenate(doc)


def _blob(at: int, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple:
    """A blob of entries that are sorted by h1; doc: places in keys, -1 for none."""
    used, local = np.unique(np.r_[-1, doc], return_inverse=True)
    return at, keys[used[1:]].tobytes(), _planes(local[1:].astype(np.uint32)), _planes(pos), _planes(np.diff(h1, prepend=np.uint64(0))), _planes(h2), False


class _Flush:
    """Entries (document, position, hash) gathered by a task."""

    def __init__(self, bins: int):
        self.bins, self.n, self.docs, self.parts = bins, 0, [], []

    def add(self, key: int, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray, by: np.ndarray | None = None) -> None:
        """by: what the bin is chosen by, the same for equal hashes; the hash itself, if None."""
        if len(pos):
            self.parts.append((np.full(len(pos), len(self.docs), np.uint32), pos.astype(np.uint32), h1, h2, self._bin(h1 if by is None else by)))
            self.docs.append(key)
            self.n += len(pos)

    def _bin(self, h: np.ndarray) -> np.ndarray:
        return _bin_of(h, self.bins)

    def blobs(self) -> Iterator[pd.DataFrame]:
        if not self.n:
            return
        doc, pos, h1, h2, b = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys = np.array(self.docs, np.int64)
        self.n, self.docs, self.parts = 0, [], []
        order = np.lexsort((h2, h1, b))
        doc, pos, h1, h2, b = doc[order], pos[order], h1[order], h2[order], b[order]
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        first = np.r_[True, ~same]
        alone = first & np.r_[~same, True]
        rows = []
        # one probe for each hash: reference 0 where this task has the hash twice, as those are settled, else 1 + its document
        ph1, ph2, ppos = h1[first], h2[first], np.where(alone[first], pos[first], 0).astype(np.uint32)
        pdoc = np.where(alone[first], doc[first].astype(np.int64), -1)
        b = b[first]
        rows += [_blob(int(b[at[0]]), keys, pdoc[at], ppos[at], ph1[at], ph2[at]) for at in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1)]
        held = ~alone
        if held.any():
            d, p = doc[held], pos[held]
            order = np.lexsort((p, d))
            d, p = d[order], p[order]
            bins = self._bin(keys.view(np.uint64))
            for at in np.split(np.arange(len(d)), np.flatnonzero(np.diff(d)) + 1):
                rows.append((int(bins[d[at[0]]]), keys[d[at[0]]].tobytes(), b"", p[at].tobytes(), b"", b"", True))
        yield pd.DataFrame(rows, columns=_NAMES)


def _deal_finely(bins: int, by_hash: bool):
    """The second level: the blobs of coarse bins, cut into blobs of fine ones. by_hash: bins go by h1; else the coarse bins stay
    together in as many fine ones as h2 gives."""

    def run(batches):
        held, settled, n = [], [], 0

        def flush():
            rows = list(settled)
            if held:
                h1, h2, pos, keys, doc, b = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((h2, h1, b))
                h1, h2, pos, doc, b = h1[order], h2[order], pos[order], doc[order], b[order]
                rows += [_blob(int(b[at[0]]), keys, doc[at], pos[at], h1[at], h2[at]) for at in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1)]
            return pd.DataFrame(rows, columns=_NAMES)

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.settled:
                    settled.append((int(_bin_of(np.frombuffer(row.docs, np.uint64), bins)[0]), *row[1:]))
                    n += len(row.pos) // 4
                else:
                    h1, h2, pos, keys, doc = _entries(pd.DataFrame([row]))
                    base = sum(len(x[3]) for x in held)
                    b = _bin_of(h1, bins) if by_hash else row.bin + COARSE * (h1.astype(np.int64) % max(1, bins // COARSE))
                    held.append((h1, h2, pos, keys, np.where(doc < 0, -1, doc + base), b))
                    n += len(h1)
                if n >= FLUSH:
                    yield flush()
                    held, settled, n = [], [], 0
        yield flush()

    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bin: the positions of each document whose hash another entry has too."""
    out_key, out_pos = [], []
    for docs, pos in zip(pdf.docs[pdf.settled], pdf.pos[pdf.settled], strict=True):
        out_key.append(np.frombuffer(docs, np.int64)[0])
        out_pos.append(pos)
    own = pdf[~pdf.settled]
    if len(own):
        h1, h2, pos, keys, doc = _entries(own)
        order = np.lexsort((h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        again = np.r_[False, same] | np.r_[same, False]
        # a hash without a reference stands for two or more entries of its task
        hit = np.zeros(len(h1), bool)
        hit[order] = again
        hit &= doc >= 0
        key, p = keys[doc[hit]], pos[hit]
        order = np.lexsort((p, key))
        key, p = key[order], p[order]
        for at in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1) if len(key) else []:
            out_key.append(key[at[0]])
            out_pos.append(p[at].tobytes())
    return pd.DataFrame({"k": np.array(out_key, np.int64), "pos": out_pos})


def _repeats(found: DataFrame, bins: int, by_hash: bool) -> DataFrame:
    """(k, pos): for each document, the blobs of positions that repeat; a document's own positions only."""
    if bins > COARSE:
        found = found.repartition(max(COARSE, shuffle_width(found.sparkSession)), "bin").mapInPandas(_deal_finely(bins, by_hash), _BLOB)
    return found.groupBy("bin").applyInPandas(_meet, "k long, pos binary").groupBy("k").agg(F.collect_list("pos").alias("pos"))


def _positions(blobs) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(map(bytes, blobs)), np.uint32)).astype(np.int64) if blobs is not None and len(blobs) else np.empty(0, np.int64)


def dedup_substrings(docs: DataFrame, window: int = 35, texts: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Remove every word that a window of `window` words covers whose word sequence also starts anywhere else.

    Words are maximal runs without 0x20 and 0x09 to 0x0D, unchanged. Returns one row for each input row: doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space), spans (binary: pairs of unsigned 32-bit
    word positions, start and end of each removed run) and, if `texts`, kept_text. A null or empty text has no words. A row that is there twice
    (same id and text) counts as two documents, so it is removed where it is long enough. A null id is an id like any
    other. Very long texts are taken whole. Other columns are not looked at, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    v, member = cover_for(window)
    short = min(8, window)
    anchor = window - v + 1
    base = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")).withColumn("k", row_key("doc_id", "t"))
    size = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bins = max(4 * shuffle_width(spark), int(size / 6 * member.mean() / BIN) + 1)
    by_key = base.repartition(shuffle_width(spark), "k")

    def anchors(batches):
        flush = _Flush(min(bins, COARSE))
        for pdf in batches:
            for k, t in zip(pdf.k, pdf.t, strict=True):
                ids = word_hashes(t)
                if len(ids) < window:
                    continue
                h = rolling(ids, anchor)
                at = np.flatnonzero(member[np.arange(len(h)) % v])
                flush.add(k, at, h[at], np.zeros(len(at), np.uint32))
                if flush.n >= FLUSH:
                    yield from flush.blobs()
        yield from flush.blobs()

    def windows(batches):
        flush = _Flush(min(bins, COARSE))
        with np.errstate(over="ignore"):
            for pdf in batches:
                for k, t, blobs in zip(pdf.k, pdf.t, pdf.pos, strict=True):
                    ids = word_hashes(t)
                    n = len(ids) - window + 1
                    a = _positions(blobs)
                    if n <= 0 or not len(a):
                        continue
                    edge = np.zeros(len(ids) + 2, np.int64)  # window p holds anchor a for p from a - v + 1 to a
                    np.add.at(edge, np.maximum(a - v + 1, 0), 1)
                    np.add.at(edge, a + 1, -1)
                    at = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                    # windows that follow each other mostly share the least hash of a short run of words, so they meet in few bins
                    least = sliding_window_view(rolling(ids, short), window - short + 1)[at].min(1)
                    flush.add(k, at, rolling(ids, window)[at], rolling(mixed(ids + MIX), window, 0xD6E8FEB86659FD93)[at].astype(np.uint32), mixed(least))
                    if flush.n >= FLUSH:
                        yield from flush.blobs()
            yield from flush.blobs()

    def kept(batches):
        for pdf in batches:
            out = []
            for d, t, blobs in zip(pdf.doc_id, pdf.t, pdf.pos, strict=True):
                words = t.split()
                p = _positions(blobs)
                edge = np.zeros(len(words) + window + 1, np.int64)
                np.add.at(edge, p, 1)
                np.add.at(edge, p + window, -1)
                gone = np.cumsum(edge)[: len(words)] > 0
                cuts = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if len(p) else b" ".join(words)
                out.append((d, len(words), int(gone.sum()), hashlib.sha256(left).hexdigest(), cuts.astype(np.uint32).tobytes(), left.decode() if texts else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    first = _repeats(base.select("k", "t").mapInPandas(anchors, _BLOB), bins, True)
    near = by_key.join(first, "k").select("k", "t", F.col("doc_id").cast("string"), "pos")  # with doc_id, so that both joins read one shuffle of the texts
    second = _repeats(near.mapInPandas(windows, _BLOB), bins, False)
    kind = base.schema["doc_id"].dataType.simpleString()
    done = by_key.join(second, "k", "left").select(F.col("doc_id").cast("string"), "t", "pos")  # as text: pandas would turn ids into floats where one is null
    return done.mapInPandas(kept, "doc_id string, n_words long, n_removed long, kept_sha256 string, spans binary, kept_text string").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "spans", *(["kept_text"] if texts else [])
    )
