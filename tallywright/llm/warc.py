"""WARC records and the resolution of not-modified revisits.

A revisit record says that a page had not changed. It is resolved by an as-of join on the canonical URL to the latest
full response captured before it; the validators (ETag, else Last-Modified) must agree, and the headers that a 304
response may update are merged over the stored ones. The as-of join runs in two levels, inside blocks of time and over
the blocks of a URL, so a URL that is captured very often does not land in one task as a whole.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_width, written

#: Seconds of a time block.
BLOCK = 86_400
#: Headers that a not-modified response updates. Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: The end-of-record mark with the start of the next record, whatever its version (1.0, 1.1).
_CUT = "\r\n\r\nWARC/1."
_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*([0-9]+)")


def canonical_url(url: str = "url") -> F.Column:
    """Scheme and host lower-cased, no fragment, no default port, no tracking parameters (utm_*, ref), an empty path as /."""
    u = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")), "&")
    return F.concat(head, F.when((head != "") & (path == ""), F.lit("/")).otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def format_records(captures: DataFrame) -> DataFrame:
    """(record): each capture (record_id, url, kind, at, status, http, payload) as a WARC/1.1 record. http: header lines, each ended by CRLF."""
    block = F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit("\r\n"), F.coalesce("http", F.lit("")), F.lit("\r\n"), F.coalesce("payload", F.lit("")))
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [("WARC-Type", F.col("kind")), ("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.col("record_id").cast("string"), F.lit(">"))), ("WARC-Target-URI", F.coalesce("url", F.lit(""))), ("WARC-Date", F.coalesce(stamp, F.lit(""))), ("Content-Type", F.lit("application/http")), ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in lines], F.lit("\r\n"))
    return captures.select(F.concat(head, block).alias("record"))


def write_warc(captures: DataFrame, path: str) -> None:
    """One .txt part of WARC records for each partition: records end with two CRLF, as the format wants."""
    format_records(captures).write.option("lineSep", "\r\n\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record), as bytes, of all files of WARC/1.0 or 1.1, not compressed: each as long as its Content-Length says. A payload may hold the
    end-of-record mark, and what follows the mark then belongs to it. Spark cuts the files at the marks; the pieces of a file
    go through one task in order, a batch at a time, where those that a record is short of are put back to it. A record that
    the end of its file cuts off comes as it is."""
    raw = spark.read.option("lineSep", _CUT).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("value"))
    cut, first = _CUT.encode(), b"WARC/1."

    def whole(batches):
        file, held, short = None, [], 0
        for pdf in batches:
            out = []
            for f, value in zip(pdf.file, pdf.value, strict=True):
                if f != file or short <= 0:
                    out += [cut.join(held)] * bool(held)
                    file, held = f, [value if value.startswith(first) else first + value]
                    head, _, block = held[0].partition(b"\r\n\r\n")
                    size = _LENGTH.search(head)
                    short = (int(size[1]) if size else 0) - len(block)
                else:
                    held.append(value)
                    short -= len(cut) + len(value)
            yield pd.DataFrame({"record": pd.Series(out, dtype=object)})
        yield pd.DataFrame({"record": pd.Series([cut.join(held)] * bool(held), dtype=object)})

    return raw.repartition(shuffle_width(spark), "file").sortWithinPartitions("file", "start", "n").mapInPandas(whole, "record binary")


def header(block: str, name: str) -> F.Column:
    """The first value of a header in the text of a header block; empty if there is none."""
    return F.regexp_extract(block, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def parse_records(records: DataFrame) -> DataFrame:
    """(record_id, url, kind, at, status, http, payload, intact, uri, body) of WARC records, as text or bytes. uri: the record's id as it
    stands; record_id: its number, for ids of format_records. body: the payload's bytes; payload is the same as text, where a
    byte that is not UTF-8 stays as it is. intact: the block is as long as its Content-Length says; of others (cut off by the end of their
    file) what there is is returned."""
    records = records.select(F.col("record").cast("string").alias("record"))
    cut = F.instr("record", "\r\n\r\n")
    r = records.select(F.substring(F.col("record"), F.lit(1), cut - 1).alias("w"), F.substr("record", cut + 4).cast("binary").alias("bytes"))
    size = F.coalesce(header("w", "Content-Length").try_cast("int"), F.lit(-1))
    whole = (F.octet_length("bytes") == size) | (F.octet_length("bytes") == size + 4)  # the last record of a file still has its end mark
    r = r.select("w", whole.alias("intact"), F.when(whole, F.substring(F.col("bytes"), F.lit(1), size)).otherwise(F.col("bytes")).cast("string").alias("block"))
    split = F.instr("block", "\r\n\r\n")
    return r.select(
        F.regexp_extract(header("w", "WARC-Record-ID"), "<urn:record:(.*)>", 1).try_cast("long").alias("record_id"),
        header("w", "WARC-Target-URI").alias("url"),
        header("w", "WARC-Type").alias("kind"),
        F.try_to_timestamp(header("w", "WARC-Date"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"),
        F.regexp_extract("block", r"^HTTP/[0-9.]+ ([0-9]+)", 1).try_cast("int").alias("status"),
        F.regexp_replace(F.substring(F.col("block"), F.lit(1), split + 1), r"^HTTP/[^\r]*\r\n", "").alias("http"),
        F.substr("block", split + 4).alias("payload"),
        "intact",
        F.regexp_replace(header("w", "WARC-Record-ID"), "^<|>$", "").alias("uri"),
        F.substr("block", split + 4).cast("binary").alias("body"),
    )


def _lines(http: str) -> F.Column:
    """The header lines as "name: value", names lower-cased."""
    found = F.filter(F.split(F.coalesce(http, F.lit("")), "\r\n"), lambda x: x.contains(":"))
    return F.transform(found, lambda x: F.concat(F.lower(F.trim(F.substring_index(x, ":", 1))), F.lit(": "), F.trim(F.substr(x, F.instr(x, ":") + 1))))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Resolve the revisits among captures (record_id, url, kind, at, status, http, payload).

    Returns one row for each revisit: record_id, canonical_url, outcome, response_id, headers (lines "name: value", sorted,
    one to a line: those of the response, with permitted ones replaced by the revisit's) and digest (sha256 of the
    response's payload). outcome: resolved; no_response (no full response, kind response with status 200, strictly
    earlier); mismatch (both have an ETag and they differ, weak marks ignored, or, where not both have one, both have
    Last-Modified and they differ); unverified (no validator to compare). Only resolved ones carry response columns.
    Of responses at the same time the one with the largest record_id counts. A null time is never earlier than
    anything, and a null URL counts as empty. Rows that repeat are resolved each. Very long payloads are only hashed. Other
    columns are not looked at, whatever their names. An empty table gives no rows.
    """
    c = captures.select("record_id", "kind", "status", "http", "payload", canonical_url("url").alias("u"), F.unix_micros("at").alias("t"))
    c = c.withColumn("block", F.floor(F.col("t") / (BLOCK * 1_000_000)))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("t").isNotNull()
    rows = c.withColumn("own", F.when(full, F.struct("t", "record_id", F.coalesce("http", F.lit("")).alias("http"), F.sha2(F.coalesce("payload", F.lit("")), 256).alias("digest"))))
    rows = rows.select("record_id", "u", "t", "block", "kind", "http", "own").where(F.col("own").isNotNull() | (F.col("kind") == "revisit"))
    rows = written(rows)  # without the payloads; both sides of the join below read it
    blocks = rows.groupBy("u", "block").agg(F.max("own").alias("last"))
    past = Window.partitionBy("u").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(F.col("u").alias("u2"), F.col("block").alias("b2"), F.max("last").over(past).alias("carried"))
    inside = Window.partitionBy("u", "block").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max("own").over(inside)).where("kind = 'revisit'")
    rows = rows.join(before, (F.col("u") == F.col("u2")) & F.col("block").eqNullSafe(F.col("b2")), "left")
    r = rows.withColumn("resp", F.when(F.col("t").isNotNull(), F.coalesce("near", "carried"))).withColumn("rh", F.concat(F.lit("\r\n"), F.coalesce("http", F.lit("")))).withColumn("sh", F.concat(F.lit("\r\n"), F.col("resp.http")))
    tag = lambda b: F.regexp_replace(header(b, "ETag"), "^W/", "")
    r = r.withColumns({"e1": tag("rh"), "e2": tag("sh"), "m1": header("rh", "Last-Modified"), "m2": header("sh", "Last-Modified")})
    both_e, both_m = (F.col("e1") != "") & (F.col("e2") != ""), (F.col("m1") != "") & (F.col("m2") != "")
    agree = F.when(both_e, F.when(F.col("e1") == F.col("e2"), "resolved").otherwise("mismatch")).when(both_m, F.when(F.col("m1") == F.col("m2"), "resolved").otherwise("mismatch")).otherwise("unverified")
    r = r.withColumn("outcome", F.when(F.col("resp").isNull(), "no_response").otherwise(agree))
    name = lambda x: F.substring_index(x, ":", 1)
    r = r.withColumns({"fresh": F.filter(_lines("http"), lambda x: name(x).isin(*PERMITTED)), "stored": _lines("resp.http")})
    r = r.withColumn("names", F.transform("fresh", name))
    merged = F.array_join(F.sort_array(F.concat(F.col("fresh"), F.filter("stored", lambda x: ~F.array_contains(F.col("names"), name(x))))), "\n")
    ok = F.col("outcome") == "resolved"
    return r.select("record_id", F.col("u").alias("canonical_url"), "outcome", F.when(ok, F.col("resp.record_id")).alias("response_id"), F.when(ok, merged).alias("headers"), F.when(ok, F.col("resp.digest")).alias("digest"))
