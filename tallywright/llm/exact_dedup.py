"""Exact deduplication of a new batch against an immutable snapshot.

A snapshot is stored once and never changed: the digests of its rows, its groups of equal digests, and static 3-wise
binary-fuse filters (Graf and Lemire, 2022) over them, one for each bucket of digests: about nine bits a key, no false
negative and one false positive in 256. Each new batch loads the filters and screens its digests by them; only the
positives join the exact buckets, where texts are compared byte for byte. Filters of up to FILTER_BYTES in all are sent to
every task, so that the batch is not shuffled for the screening; larger ones meet its digests bucket by bucket.
Duplicates within the new batch are grouped on their own, by digest, with a map-side combine.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import hub_join, scratch_dir
from .common import mixed, shuffle_width, written

#: Snapshot digests of a bucket, on average; and bytes of filters that are sent to every task, at most.
BUCKET, FILTER_BYTES = 200_000, 32_000_000


def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots and the 8-bit fingerprint of each key."""
    with np.errstate(over="ignore"):
        h = mixed(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    slots = np.stack([first, (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask), (first + np.uint64(2 * segment)) ^ (h & mask)], 1)
    return slots.astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segment count, table) of a filter over distinct 64-bit keys. Keys are peeled in rounds:
    all that are alone in one of their slots go at once, and get their slot's value when the rounds are undone."""
    keys = np.unique(keys)
    n = len(keys)
    segment = 4 if n < 2 else min(2**18, 2 ** math.floor(math.log(n) / math.log(3.33) + 2.25))
    size = 0 if n < 2 else round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    count = max(1, math.ceil(size / segment) - 2)
    for seed in range(1, 1000):
        slots, prints = _places(keys, seed * 0x9E3779B9, segment, count)
        slots_n = (count + 2) * segment
        left, rounds = np.arange(n), []
        while len(left):
            s = slots[left]
            degree = np.bincount(s.ravel(), minlength=slots_n)
            alone = degree[s] == 1
            gone = alone.any(1)
            if not gone.any():
                break
            rounds.append((left[gone], alone[gone].argmax(1)))
            left = left[~gone]
        if not len(left):
            table = np.zeros(slots_n, np.uint8)
            for who, which in reversed(rounds):
                s = slots[who]
                own = s[np.arange(len(who)), which]
                table[own] = 0
                table[own] = prints[who] ^ table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]
            return seed, segment, count, table.tobytes()
    raise RuntimeError("no seed gave a filter")


def may_hold(keys: np.ndarray, seed: int, segment: int, count: int, table: bytes) -> np.ndarray:
    slots, prints = _places(keys, seed * 0x9E3779B9, segment, count)
    t = np.frombuffer(table, np.uint8)
    return (t[slots[:, 0]] ^ t[slots[:, 1]] ^ t[slots[:, 2]]) == prints


def _digests(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, sha, text_key): SHA-256 and XXH64 of each text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("text_key"))


def _groups(digests: DataFrame) -> DataFrame:
    return digests.groupBy("sha").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"), F.min("text_key").alias("text_key"))


def _keyed(groups: DataFrame, buckets: int | F.Column) -> DataFrame:
    key = F.xxhash64("sha")
    return groups.select("sha", key.alias("key"), F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"))


def write_snapshot(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Store what later batches need of the snapshot docs: path/digests (doc_id, sha, text_key), path/groups (sha, top,
    n, text_key) and path/filters (bucket, buckets, seed, segment, segments, bits). The texts are read once."""
    spark = docs.sparkSession
    _digests(docs, text_col, id_col).write.parquet(f"{path}/digests")
    _groups(spark.read.parquet(f"{path}/digests")).write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    buckets = max(shuffle_width(spark), math.ceil(groups.count() / BUCKET))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, count, table = build_filter(pdf.key.to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame([(pdf.bucket.iloc[0], buckets, seed, segment, count, table)], columns=["bucket", "buckets", "seed", "segment", "segments", "bits"])

    filters = _keyed(groups, buckets).select("key", "bucket").groupBy("bucket").applyInPandas(build, "bucket int, buckets int, seed int, segment int, segments int, bits binary")
    filters.write.parquet(f"{path}/filters")


def screen(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """(sha): the digests of groups that a filter of the snapshot may hold."""
    size = filters.agg(F.max("buckets").alias("buckets"), F.sum(F.octet_length("bits") + 100).alias("size")).first()
    if not size["buckets"]:
        return groups.select("sha").where("false")
    keyed = _keyed(groups, size["buckets"])

    def hits(pdf: pd.DataFrame, f) -> pd.DataFrame:
        return pdf.loc[may_hold(pdf.key.to_numpy(np.int64).view(np.uint64), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["bits"]), ["sha"]]

    if size["size"] <= FILTER_BYTES:
        sent = groups.sparkSession.sparkContext.broadcast({r["bucket"]: {**r.asDict(), "bits": bytes(r["bits"])} for r in filters.toLocalIterator()})

        def probe(batches):
            for pdf in batches:
                for bucket, own in pdf.groupby("bucket"):
                    if bucket in sent.value:
                        yield hits(own, sent.value[bucket])

        return keyed.mapInPandas(probe, "sha binary")

    def meet(f: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        return hits(pdf, f.iloc[0]) if len(f) and len(pdf) else pd.DataFrame({"sha": pd.Series([], dtype=object)})

    return filters.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInPandas(meet, "sha binary")


def exact_duplicates(snapshot: DataFrame, incoming: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Groups of equal texts over an old snapshot and a new batch. path: where write_snapshot() stored the snapshot; if
    None, it is stored in the shared folder first.

    Returns one row for each row of both: doc_id, keep_id (largest doc_id of the group), group_size, kept (doc_id is
    keep_id), text_sha256. Texts are compared unchanged, however long; null counts as empty. A null doc_id is never the
    largest unless the group has no other, and then keep_id is null and the rows are kept. Rows that repeat with the same
    doc_id and text count each, and all of them carry kept = true where theirs is the largest id: they cannot be told
    apart. Other columns are not looked at, whatever their names. Empty tables, either or both, give no rows of theirs.
    """
    spark = snapshot.sparkSession
    if path is None:
        path = scratch_dir(spark)
        write_snapshot(snapshot, path, text_col, id_col)
    old, old_groups, filters = (spark.read.parquet(f"{path}/{x}") for x in ("digests", "groups", "filters"))
    new = written(_digests(incoming, text_col, id_col))
    new_groups = written(_groups(new))
    positives = written(screen(new_groups, filters))

    def sample(docs: DataFrame, groups: DataFrame) -> DataFrame:
        """One text of each digest that the filters let through. The id is part of the key, which spreads large groups."""
        wanted = groups.join(positives, "sha").select(F.col("sha").alias("digest"), "top", F.col("text_key").alias("key"))
        text = F.coalesce(F.col(text_col), F.lit(""))
        texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
        found = texts.join(wanted, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("top")))
        return found.where(F.unhex(F.sha2("text", 256)) == F.col("digest")).select(F.col("digest").alias("sha"), "text")

    # the exact buckets, compared byte for byte
    same = sample(snapshot, old_groups).join(sample(incoming, new_groups).withColumnRenamed("text", "other"), "sha").where(F.col("text") == F.col("other")).select("sha").distinct()
    matched = written(same)
    side = [F.lit(bytearray([i])) for i in (0, 1)]  # digests that are equal though the texts differ stay apart
    plain = [g.select("sha", "top", "n") for g in (old_groups, new_groups)]
    joint = plain[0].join(matched, "sha").union(plain[1].join(matched, "sha")).groupBy("sha").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    groups = joint.select(F.explode(F.array(*[F.concat("sha", x) for x in side])).alias("k"), "top", "n")
    for g, x in zip(plain, side, strict=True):
        groups = groups.union(g.join(matched, "sha", "left_anti").select(F.concat("sha", x), "top", "n"))
    rows = old.select("doc_id", "sha", F.concat("sha", side[0]).alias("k")).union(new.select("doc_id", "sha", F.concat("sha", side[1])))
    out = hub_join(rows, written(groups), "k")
    return out.select("doc_id", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def dedup_table(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """exact_duplicates over one table: half of its rows, by a hash of their ids, is the snapshot and the rest the batch."""
    half = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0
    return exact_duplicates(docs.where(half), docs.where(~half), None, text_col, id_col)
