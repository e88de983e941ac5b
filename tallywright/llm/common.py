"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import hub_join, scratch_dir

#: An odd constant that mixes bits (2**64 over the golden ratio).
MIX = np.uint64(0x9E3779B97F4A7C15)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lost executors do not lose it, and its lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch that goes to a Python worker: texts are long, and the JVM and the worker each hold some batches.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's spark.sql.execution.arrow.maxRecordsPerBatch to BATCH_ROWS, where it is Spark's default of 10000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: str = "text") -> F.Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def row_key(*cols: str) -> F.Column:
    """A 64-bit key of a row's content: rows that repeat share it."""
    return F.xxhash64(*[F.col(c) for c in cols])


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every word of the text, in order. bytes.split() cuts at 0x20 and 0x09 to 0x0D only."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FIRST = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)  # masks of the first bytes of a word of eight
#: Bytes of texts that are cut into words at a time, about; and the length from which a word is hashed on its own.
PIECE, LONG_WORD = 1 << 20, 64


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): 64-bit hashes of the words of all texts, one after another, and where each text's words begin, and the last ones end. Words
    are what bytes.split() gives; they are found and hashed eight bytes at a time for all words at once."""
    raw = b"\n".join([b"", *texts, bytes(8)])
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    space[-8:] = True
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(b) - 7,), "<u8", raw, 0, (1,))
    h = mixed((eight[start] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * MIX))
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < LONG_WORD:
        left = size[more] - at
        h[more] = mixed(h[more] * MIX + (eight[start[more] + at] & _FIRST[np.minimum(left, 8)]))
        more, at = more[left > 8], at + 8
    for i in more.tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + size[i]])
    return h, np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def shingle_sets(texts: Iterable[bytes], ngram: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct n-grams of words, A-Z lower-cased; with fewer words, one hash of all; without words, none."""
    held, size = [], 0
    for t in chain(texts, [None]):
        if t is not None:
            held.append(t.lower())
            size += len(t)
        if size < PIECE and t is not None:
            continue
        h, cuts = text_words(held)
        grams = rolling(h, ngram)
        for a, b in pairwise(cuts.tolist()):
            if b - a < ngram:
                yield rolling(h[a:b], b - a) if b > a else h[:0]
                continue
            s = np.sort(grams[a : b - ngram + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        held, size = [], 0


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(ids: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of `width` ids: a polynomial modulo 2**64, by doubling, so that no power has to be inverted."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done = np.zeros(n, np.uint64), 0
    block, size, b = ids, 1, base
    with np.errstate(over="ignore"):
        while True:  # block[i] is the hash of the `size` ids from i on, and b is base**size
            if width & size:
                out = out * np.uint64(b) + block[done : done + n]
                done += size
            if done == width:
                return mixed(out)
            block = block[:-size] * np.uint64(b) + block[size:]
            size, b = size * 2, b * b % 2**64


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, for all i one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


#: Edges of a task of components(), about.
EDGES = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b) of longs: one row (node, root) for each node that has an edge,
    root being the component's smallest node. Alternates the large-star and small-star steps; each takes the least
    smaller neighbour with a map-side combine and joins it back by hub_join, so no neighbourhood meets in one task.
    The work on each round is cut off in the shared folder; the number of edges never grows. Few edges are few files and tasks."""
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    pairs = written(pairs)
    before, tasks = None, max(1, -(-pairs.count() // EDGES))
    tidy = lambda df: df.distinct().coalesce(min(tasks, shuffle_width(df.sparkSession)))
    for _ in range(max_rounds):
        least = pairs.groupBy("hi").agg(F.min("lo").alias("m"))
        large = hub_join(pairs, least.withColumnRenamed("hi", "lo"), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        large = written(tidy(large))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = hub_join(large, least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = written(tidy(small.union(least.select("hi", F.col("m").alias("lo")))))
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if now == before:
            roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
