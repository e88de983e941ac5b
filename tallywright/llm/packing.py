"""Packing of tokenized documents into fixed-length sequences with a bounded number of open windows.

Each partition reads its documents once. Full windows are cut from a long document as they are. What is left of it goes
to the open window that it fills best; if it fits in none, the fullest window is emitted and a new one opened. At most
`open_windows` windows are open in a partition. The windows still open at its end are merged with those of other
partitions, as wholes, by the same rule.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, shuffle_width, small_batches, written
from .tokens import crcs, ended, word_memo

#: Partitions whose open windows are merged together: a merge has at most OPEN * FAN windows.
OPEN, FAN = 64, 256
_PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, leftover boolean"


class BestFit:
    """Open windows by the room they have left. place() returns the window and offset of an item, and the windows that it had to emit."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.rooms, self.made = size, most, [], 0  # rooms: sorted (room, window)

    def full(self) -> int:
        """A new window that an item fills by itself."""
        self.made += 1
        return self.made - 1

    def place(self, length: int) -> tuple[int, int, list[int]]:
        at, emitted = bisect.bisect_left(self.rooms, (length, -1)), []
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                emitted.append(self.rooms.pop(0)[1])  # the least room: the fullest
            room, window, self.made = self.size, self.made, self.made + 1
        if room > length:
            bisect.insort(self.rooms, (room - length, window))
        else:
            emitted.append(window)
        return window, self.size - room, emitted


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, open_windows: int = OPEN, with_ids: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pack the token ids of every text (null: empty), each text ended by `end_id`, into sequences of at most `size` ids.

    Returns one row for each piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (gapless from 0 in each sequence) and, if with_ids, ids. Each id lies in exactly one piece. Rows
    that repeat are packed each; a null doc_id stays null. An empty text is the end id alone; a very long one fills
    windows by itself. sequence_id is unique but not dense. Other columns are not looked at, whatever their names. An
    empty table gives no pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_(), *([pa.list_(pa.int32())] if with_ids else [])]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "leftover", *(["ids"] if with_ids else [])]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        memo, fit = word_memo(tokenizer), BestFit(size, open_windows)
        base = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple]] = {}
        out: list[tuple] = []
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, n in memo.encode(batch.column(1)):
                ids, n = ended(ids, n, end_id)
                to = np.cumsum(n)
                # the pieces of all documents, cut at multiples of the size from each document's start
                cuts = -(-n // size)
                start = ragged(np.zeros(len(n), np.int64), cuts) * size
                doc = np.repeat(np.arange(len(n)), cuts)
                at = (to - n)[doc] + start
                sums = crcs(ids, np.r_[at, len(ids)])
                for d, a, p, c in zip(doc.tolist(), start.tolist(), at.tolist(), sums, strict=True):
                    length = min(size, int(n[d]) - a)
                    more = [ids[p : p + length].tolist()] if with_ids else []
                    if length == size:
                        out.append((doc_ids[first + d], a, length, c, int(n[d]), base | fit.full(), 0, False, *more))
                        continue
                    window, offset, emitted = fit.place(length)
                    held.setdefault(window, []).append((doc_ids[first + d], a, length, c, int(n[d]), base | window, offset, False, *more))
                    for w in emitted:
                        out += held.pop(w)
                if len(out) > 20_000:
                    yield table(out)
                    out = []
        out += [(*p[:7], True, *p[8:]) for w in held.values() for p in w]
        if out:
            yield table(out)

    source = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pieces = written(source.mapInArrow(run, _PIECE + ", ids array<int>" * with_ids))
    left = pieces.where("leftover").groupBy("window").agg(F.sum("length").alias("filled"))
    group = F.shiftright("window", 32 + FAN.bit_length() - 1)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["filled", "window"], ascending=[False, True])
        fit, rows = BestFit(size, len(pdf)), []
        first = (1 << 62) | (int(pdf["group"].iloc[0]) << 24)
        for window, filled in zip(pdf.window, pdf.filled, strict=True):
            into, offset, _ = fit.place(int(filled))
            rows.append((window, first | into, offset))
        return pd.DataFrame(rows, columns=["window", "sequence_id", "base"])

    moved = left.withColumn("group", group).repartition(shuffle_width(spark), "group").groupBy("group").applyInPandas(merge, "window long, sequence_id long, base long")
    rest = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = ["ids"] if with_ids else []
    done = pieces.where("not leftover").select(*rest, F.col("window").alias("sequence_id"), "offset", *ids)
    late = pieces.where("leftover").join(moved, "window").select(*rest, "sequence_id", (F.col("offset") + F.col("base")).alias("offset"), *ids)
    return done.union(late).withColumn("doc_id", F.col("doc_id").cast(kind))
