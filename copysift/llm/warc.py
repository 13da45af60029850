"""WARC archives: records written by Spark's own writer, and a reader that salvages damaged archives.

Writing. A record is a string made by SQL functions and ends with two line breaks, so Spark's text writer with that
separator writes valid uncompressed archives, to any store that Spark can write to and with its commit
protocol. Of records with equal payloads of at least ``least`` bytes, the one with the largest id carries
the payload and the others are revisits that refer to it. Only digests are shuffled to find them; the few
revisits are broadcast to the pages while their counted number allows it, else joined.

A file ends when it has ``ARCHIVE_BYTES``, so what a reading task holds is bounded by bytes and not by a number of records.

Reading. An archive is one row of bytes, parsed in a task. Every record is checked (version line, headers,
length, end marker, block digest, payload digest). Where a check fails, the reader looks for the next place
where a valid record begins (a version line, or a gzip member), goes on from there and logs the bytes
between as quarantined, with the reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copysift.llm.frames import cut, small_enough

END = "\r\n\r\n"
#: Bytes after which a new archive is begun; with the record that goes beyond it they bound the memory of a reading task.
ARCHIVE_BYTES = 64_000_000
#: Bytes that a gzip member may have inside; a larger one is quarantined with that reason.
MEMBER_BYTES = 1 << 30
LEAST_BYTES = 1000
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"


def roles(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, refers_to) of the pages that are revisits: their payload, of ``least`` bytes or more, is that of a page with a larger id."""
    big = pages.select("page_id", payload().alias("payload")).where(F.octet_length("payload") >= least)
    digests = big.select("page_id", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").alias("size"))
    groups = digests.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    return digests.join(small_enough(cut(groups.drop("n"))), ["digest", "size"]).where("page_id < refers_to").select("page_id", "refers_to").distinct()


def payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(record): a WARC record as text, without its end, for each row of page_id, url, html."""
    text, line = F.col("payload"), lambda *parts: F.concat(*parts, F.lit("\r\n"))
    revisits = small_enough(cut(roles(pages, least)))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"), payload().alias("payload")).join(revisits, "page_id", "left")
    again = F.col("refers_to").isNotNull()
    size = F.octet_length(text).cast("string")
    http = F.concat(line(F.lit("HTTP/1.1 200 OK")), line(F.lit("Content-Type: text/html; charset=utf-8")), line(F.lit("Content-Length: "), size), F.lit("\r\n"))
    rows = rows.withColumn("block", F.when(again, http).otherwise(F.concat(http, text)))
    digest = lambda c: F.concat(F.lit("sha1:"), F.sha1(c.cast("binary")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        line(F.lit("WARC/1.1")),
        line(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        line(F.lit("WARC-Date: 1970-01-01T00:00:00Z")),
        line(F.lit("WARC-Target-URI: "), F.col("url")),
        F.when(again, F.concat(line(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line(F.lit("WARC-Refers-To: "), name(F.col("refers_to"))))).otherwise(F.lit("")),
        line(F.lit("WARC-Payload-Digest: "), digest(text)),
        line(F.lit("WARC-Block-Digest: "), digest(F.col("block"))),
        line(F.lit("Content-Type: application/http; msgtype=response")),
        line(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, F.col("block")).alias("record"))


def filed(rows: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """(file, record): the records in their order, with the number of the file within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size = 0, 0
        for batch in batches:
            files = []
            for n in pc.binary_length(batch.column("record")).to_pylist():
                if size >= most:
                    file, size = file + 1, 0
                size += n
                files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), batch.column("record")], names=["file", "record"])

    return rows.select("record").mapInArrow(run, "file int, record string")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, most: int = ARCHIVE_BYTES) -> None:
    """Writes pages (page_id, url, html; nulls are empty) as archives of about ``most`` bytes below ``path``."""
    filed(records(pages, least), most).write.mode("overwrite").option("lineSep", END).partitionBy("file").text(path)


def _headers(data: bytes, at: int, stop: int) -> dict[str, str] | None:
    """The headers between two places; None at the first row that is none."""
    out = {}
    while True:
        over = data.find(b"\r\n", at, stop)
        name, colon, value = data[at : over if over >= 0 else stop].partition(b":")
        if not colon or not name.strip():
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        if over < 0:
            return out
        at = over + 2


class _Ahead:
    """The first place of a mark at or behind places that only grow; it is searched again once it has been passed, so all searches together read the data once."""

    def __init__(self, search: Callable[[int], int], end: int) -> None:
        self.search, self.end, self.place = search, end, -1

    def __call__(self, at: int) -> int:
        if self.place < at:
            found = self.search(at)
            self.place = found if found >= 0 else self.end
        return self.place


def _digest_fits(stated: str | None, data: bytes) -> bool:
    if not stated or not stated.lower().startswith("sha1:"):
        return True
    value = stated[5:]
    found = hashlib.sha1(data)
    if len(value) == 32:
        return value.upper() == base64.b32encode(found.digest()).decode()
    return value.lower() == found.hexdigest()


def parse_record(data: bytes, at: int, blank: Callable[[int], int]) -> tuple[dict, int] | str:
    """The record that begins at ``at`` and the place behind it, or what is wrong with it. blank: the next blank line from a place on, or the end of the data."""
    m = _VERSION.match(data, at)
    if not m:
        return "no version line"
    stop = blank(m.end())
    if stop == len(data):
        return "headers do not end"
    head = _headers(data, m.end(), stop)
    if head is None:
        return "bad header"
    if not head.get("content-length", "").isdigit() or not head.get("warc-type"):
        return "no length or type"
    begin = stop + 4
    over = begin + int(head["content-length"])
    if over + 4 > len(data):
        return "cut short"
    if data[over : over + 4] != b"\r\n\r\n":
        return "no end marker"
    block = data[begin:over]
    if not _digest_fits(head.get("warc-block-digest"), block):
        return "block digest differs"
    http, split, body = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    if head["warc-type"] != "revisit" and not _digest_fits(head.get("warc-payload-digest"), body):
        return "payload digest differs"
    size = len(body)
    if head["warc-type"] == "revisit":
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(stated[1]) if stated else None
    return head | {"http": http, "payload": body, "size": size}, over + 4


def salvage(data: bytes, packed: bool = True) -> tuple[list[tuple[int, dict]], list[tuple[int, int, str]]]:
    """(records with their places, quarantined gaps as (start, end, reason)) of an archive, plain or, if ``packed``, gzip members (which hold no further ones)."""
    found, gaps = [], []
    at, bad, reason = 0, -1, ""
    blank = _Ahead(lambda place: data.find(b"\r\n\r\n", place), len(data))
    line = _Ahead(lambda place: m.start() if (m := _VERSION.search(data, place)) else -1, len(data))
    member = _Ahead(lambda place: data.find(_GZIP, place) if packed else -1, len(data))

    def good(place: int) -> None:
        nonlocal bad
        if bad >= 0:
            gaps.append((bad, place, reason))
            bad = -1

    def wrong(place: int, why: str) -> None:
        nonlocal bad, reason
        if bad < 0:
            bad, reason = place, why

    while at < len(data):
        if packed and data.startswith(_GZIP, at):
            opened = _member(data, at)
            if isinstance(opened, tuple):
                inner, over = opened
                records_, inner_gaps = salvage(inner, False)
                if records_ or not inner:
                    good(at)
                    found += [(at, r) for _, r in records_]
                    gaps += [(at, over, f"in the member: {why}") for _, _, why in inner_gaps]
                    at = over
                    continue
            wrong(at, opened if isinstance(opened, str) else "bad gzip member")
        else:
            got = parse_record(data, at, blank)
            if not isinstance(got, str):
                good(at)
                found.append((at, got[0]))
                at = got[1]
                continue
            wrong(at, got)
        at = min(line(at + 1), member(at + 1))
    good(len(data))
    return found, gaps


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The content of the gzip member at ``at`` and the place behind it, or what is wrong with it."""
    one, view, out, size = zlib.decompressobj(31), memoryview(data), [], 0
    try:
        while not one.eof:
            if at >= len(data):
                return "gzip member cut short"
            piece = one.decompress(view[at : at + (1 << 16)])
            size += len(piece)
            if size > MEMBER_BYTES:
                return "gzip member too large"
            out.append(piece)
            at += 1 << 16
    except zlib.error:
        return "bad gzip member"
    return b"".join(out), min(at, len(data)) - len(one.unused_data)


_KIND = "archive string, place long, record_type string, record_id string, refers_to_id string, target_uri string, stated_digest string, size long, payload binary, gap_end long, reason string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below ``path``, and one for each quarantined gap.

    Records: archive, place, record_type, record_id, refers_to_id, target_uri, stated_digest, size (of the full
    payload, also for revisits), payload. Gaps have record_type "quarantined", place, gap_end and reason.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _KIND.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]] for x in _KIND.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                found, gaps = salvage(content.as_py())
                rows = [(path.as_py(), at, r["warc-type"], r.get("warc-record-id"), r.get("warc-refers-to"), r.get("warc-target-uri"), r.get("warc-payload-digest"), r["size"], r["payload"], None, None) for at, r in found]
                rows += [(path.as_py(), a, "quarantined", None, None, None, None, None, None, b, why) for a, b, why in gaps]
                for k in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 500], strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, _KIND)


def page_of(record_id: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def archived(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> DataFrame:
    """Writes ``pages`` to archives below ``path``/archives and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    payload_digest is the bare SHA-1 of the full payload: computed again from a response, as stated for a revisit.
    Null html is an empty payload; a null page_id is a response that nothing refers to. Of rows with the same
    page_id and payload all are responses or all are revisits. An empty table gives no rows.

    Gaps are logged as Parquet (archive, place, gap_end, reason) below ``path``/gaps; as these archives have just been written, it is an
    error if there are any, or if not as many records are read as there are pages.
    """
    write_archives(pages, f"{path}/archives", least)
    digest = F.when(F.col("record_type") == "revisit", F.lower(F.substring_index("stated_digest", ":", -1))).otherwise(F.sha1("payload"))
    names = ("archive", "place", "gap_end", "reason", "record_type")
    rows = cut(read_archives(pages.sparkSession, f"{path}/archives").select(*names, page_of(F.col("record_id")).alias("page_id"), F.col("size").alias("payload_bytes"), digest.alias("payload_digest"), page_of(F.col("refers_to_id")).alias("refers_to")))
    gaps = rows.where("record_type = 'quarantined'")
    gaps.select(*names[:4]).write.mode("overwrite").parquet(f"{path}/gaps")
    rows = rows.where("record_type != 'quarantined'")
    read, written, lost = rows.count(), pages.count(), gaps.count()
    if lost or read != written:
        raise RuntimeError(f"{written} pages were written and {read} read, {lost} gaps are in {path}/gaps")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
