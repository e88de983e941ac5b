"""Token files: frequency-ranked ids in byte-aligned variable-length code, control bytes apart from data bytes.

The file format is a Parquet table of blocks. A block holds the ids of a run of documents in ascending doc_id order:
  shard, block     place of the block in the order
  n                number of ids
  doc_ids          the documents' ids, as text
  lengths          unsigned 32-bit number of ids of each document
  control          two bits for each id, four ids a byte, low bits first: bytes of its code less one
  data             the codes: each id's frequency rank, little-endian, in as few bytes as it needs
and beside it lies the table of ranks (rank, id): rank 0 is the id that is most frequent over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.lineage import scratch_dir
from .common import small_batches, written
from .tokens import crcs, ended, word_memo

#: Ids of a block, about.
BLOCK = 500_000
#: For each control byte, the lengths of its four codes.
_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int8)
_RAW = "shard int, block int, n long, doc_ids array<string>, lengths binary, raw binary, counts binary"
_BLOCKS = "shard int, block int, n long, doc_ids array<string>, lengths binary, control binary, data binary"
_SMALL, _LARGE = b"\2\0\0\0", b"\4\0\0\0"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of the ranks."""
    wide = len(ranks) > 0 and int(ranks.max()) > 0xFFFF
    r = np.ascontiguousarray(ranks, "<u4" if wide else "<u2")
    limits = (0xFF, 0xFFFF, 0xFFFFFF) if wide else (0xFF,)
    over = [r > x for x in limits]
    code = np.zeros(-len(r) % 4 + len(r), np.uint8)
    for o in over:
        code[: len(r)] += o
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    keep = np.ones((len(r), r.itemsize), bool)
    for k in range(1, r.itemsize):
        keep[:, k] = over[k - 1]
    return control.astype(np.uint8).tobytes(), r.view(np.uint8)[keep.ravel()].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks, by a look-up of the lengths of each control byte."""
    width = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    start = np.cumsum(width, dtype=np.int64) - width
    out = raw[start].astype(np.uint32)
    for k in range(1, int(width.max(initial=1))):
        at = np.flatnonzero(width > k)
        if len(at):
            out[at] |= raw[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[:1] == _SMALL[:1] else "<u4", offset=4)


def _row(shard: int, block: int, doc_ids: pa.Array | None, n: np.ndarray, ids: np.ndarray, counts: bytes | None = None) -> pa.RecordBatch:
    small = not len(ids) or ids.max() < 65536
    raw = (_SMALL if small else _LARGE) + ids.astype("<u2" if small else "<u4").tobytes()
    names = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), doc_ids if doc_ids is not None else pa.array([], pa.string()))
    values = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), names, *(pa.array([x], pa.binary()) for x in (n.astype("<u4").tobytes(), raw, counts))]
    return pa.RecordBatch.from_arrays(values, ["shard", "block", "n", "doc_ids", "lengths", "raw", "counts"])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Encode every text (null: empty), end each with `end_id` and write the blocks to path/blocks, the ranks to path/ranks.

    Documents are dealt into ranges of doc_id and sorted there; null ids come first, rows with equal ids in the order of
    their texts (whose beginning is part of the range, so that rows that share an id, or have none, are dealt out too). Texts
    are encoded once, and the ids counted as they come: they are kept, two or four bytes each, in the shared folder until
    the frequencies over all documents are known. The table of counts has at most as many rows as there are token ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).repartitionByRange(F.col("doc_id"), F.substring("t", 1, 64)).sortWithinPartitions("doc_id", "t")
    ordered = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "t")

    def ids(batches):
        memo, shard, block, total = word_memo(tokenizer), TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)
        for batch in batches:
            for first, x, n in memo.encode(batch.column(1)):
                x, n = ended(x, n, end_id)
                c = np.bincount(x, minlength=len(total))
                c[: len(total)] += total
                total = c
                to = np.cumsum(n)
                edges = np.unique(np.r_[0, np.flatnonzero(np.diff(to // BLOCK)) + 1, len(n)])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    yield _row(shard, block, batch.column(0).slice(first + a, b - a), n[a:b], x[to[a] - n[a] : to[b - 1]])
                    block += 1
        used = np.flatnonzero(total)
        yield _row(shard, -1, None, np.empty(0, np.int64), np.empty(0, np.int64), used.astype("<u4").tobytes() + total[used].astype("<i8").tobytes())

    def counts(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                k = len(raw) // 12
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<u4", k).astype(np.int64)), pa.array(np.frombuffer(raw, "<i8", k, 4 * k))], ["id", "n"])

    raw = written(ordered.mapInArrow(ids, _RAW))
    ranks = raw.where("block < 0").select("counts").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(ranks.collect(), key=lambda r: (-r["n"], r["id"]))
    order = np.array([r["id"] for r in ranked], np.int64)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order))

    def encoded(batches):
        for batch in batches:
            pairs = [encode_ranks(rank[_ids(x.as_py())]) for x in batch.column("raw")]
            done = [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "block", "n", "doc_ids", "lengths")), *done], ["shard", "block", "n", "doc_ids", "lengths", "control", "data"])

    raw.where("block >= 0").drop("counts").mapInArrow(encoded, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, id_type: str = "long") -> DataFrame:
    """Decode the files: one row for each document with doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, if with_ids, the ids. Where a block starts is summed up from the blocks' numbers of ids: within a
    shard by a window over its blocks, then over the shards' totals, of which there are as many as the file has shards."""
    blocks = spark.read.parquet(f"{path}/blocks")
    order = np.array([r["id"] for r in sorted(spark.read.parquet(f"{path}/ranks").collect(), key=lambda r: r["rank"])], np.uint32)  # as many as token ids
    names = ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def decoded(batches):
        for batch in batches:
            for shard, block, doc_ids, lengths, control, data in zip(*(batch.column(c) for c in ("shard", "block", "doc_ids", "lengths", "control", "data")), strict=True):
                n = np.frombuffer(lengths.as_py(), "<u4").astype(np.int64)
                edges = np.r_[0, np.cumsum(n)]
                ids = order[decode_ranks(control.as_py(), data.as_py(), int(edges[-1]))]
                same = [pa.array(np.full(len(n), x.as_py(), np.int32)) for x in (shard, block)]
                more = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int64)))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*same, doc_ids.values, pa.array(edges[:-1]), pa.array(n), pa.array(crcs(ids.astype("<u4"), edges), pa.int64()), *more], names)

    docs = blocks.mapInArrow(decoded, "shard int, block int, doc_id string, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    each = blocks.select("shard", "block", "n")
    shards = each.groupBy("shard").agg(F.sum("n").alias("total"))
    up_to = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    firsts = shards.select("shard", F.coalesce(up_to, F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = each.withColumn("within", within).join(firsts, "shard").select("shard", "block", (F.col("first") + F.col("within")).alias("first"))
    return docs.join(places, ["shard", "block"]).select(
        F.col("doc_id").cast(id_type).alias("doc_id"), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, with_ids: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the token files (to path, or into the shared folder) and read them back. One row for each input row: an
    empty or null text has the end id alone, a very long one is a block of its own. Rows that repeat follow each other;
    rows with equal ids (or none) stand in the order of their texts. Other columns are not looked at, whatever
    their names. An empty table gives empty files."""
    path = path or scratch_dir(docs.sparkSession)
    write_tokens(docs, tokenizer, path, end_id, text_col, id_col)
    return read_tokens(docs.sparkSession, path, with_ids, docs.schema[id_col].dataType.simpleString())
