"""WARC archives: resolving revisits by payload digest, writing deduplicated archives with fresh headers, reading them.

Only headers (page, digest, size) are shuffled by digest; the payload is never gathered by its digest, so any number of copies may
share one. The first page of each digest with copies is stored, and joining it to the headers has plain tables on both
sides, which lets Spark split a digest that holds a large part of all pages. Payloads then meet their verdict by page. Archives are
written by Spark's text writer (a record ends with the blank lines that the writer puts after each row), gzip-compressed, at most
FILE_BYTES of records a file, a larger record in a file of its own, and read file by file, unpacked as a stream.

Rows: a null payload counts as empty; a null url is written as an empty target; line breaks in a url become spaces. A null page
id is written without an id, takes part in no revisit, and comes back as null. Rows that repeat a page id with the same payload are all
responses if the id is the payload's smallest. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm.common import new_folder, stored, table

FILE_BYTES = 64 << 20
RECORD_BYTES = 16 << 10  # the smallest class of records; each class above is 16 times larger
HEAD_BYTES = 1_000
MIN_BYTES = 0  # smaller payloads are always responses
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits, as ten hexadecimal digits, make eight characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_digest(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("digest"))


def revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """`page_id, digest, refers_to, refers_url` of the pages whose payload a page of smaller id has already."""
    headers = headers.filter(F.col("page_id").isNotNull() & (F.col("bytes") >= min_bytes)).select("page_id", "digest", "url")
    first = stored(headers.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last"),
                                                 F.min_by("url", F.struct("page_id", "url")).alias("refers_url"))
                   .filter("refers_to < _last").drop("_last"), "originals")
    found = headers.join(first, "digest").filter("page_id > refers_to")
    return found.select("page_id", "digest", "refers_to", "refers_url").distinct()


def _head(*lines: tuple[str, Column | str]) -> Column:
    parts = [F.lit("WARC/1.1")]
    for name, value in lines:
        parts += [F.lit(f"\r\n{name}: "), F.lit(value) if isinstance(value, str) else value]
    return F.concat(*parts, F.lit(_END))


def records(pages: DataFrame, decided: DataFrame) -> DataFrame:
    """One text a page: the WARC record without its closing blank lines."""
    joined = pages.join(decided, ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(_END))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    common = [("WARC-Record-ID", urn("page_id")), ("WARC-Target-URI", F.col("url")), ("WARC-Date", DATE),
              ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", F.octet_length(block).cast("string"))]
    response = _head(("WARC-Type", "response"), *common)
    revisit = _head(("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn("refers_to")),
                    ("WARC-Refers-To-Target-URI", F.col("refers_url")), ("WARC-Refers-To-Date", DATE))
    return joined.select(F.concat(F.when(again, revisit).otherwise(response), block).alias("value"))


def size_classes(record_bytes: int = RECORD_BYTES, file_bytes: int = FILE_BYTES) -> list[tuple[int, int | None, int]]:
    """`(from, below, records a file)`: a file of records below s bytes holds at most file_bytes / s of them, a record of file_bytes
    or more has a file of its own."""
    steps = [0]
    size = record_bytes
    while size < file_bytes:
        steps.append(size)
        size *= 16
    return [(low, top, max(1, file_bytes // (top or file_bytes))) for low, top in zip(steps, [*steps[1:], file_bytes])] + [(file_bytes, None, 1)]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, record_bytes: int = RECORD_BYTES,
                   file_bytes: int = FILE_BYTES) -> None:
    """Writes `pages(page_id, url, html)` as deduplicated archives, one size class of records after the other; classes without
    pages are left out. Sizes are those of payload and url with HEAD_BYTES for the header."""
    read = with_digest(pages).withColumn("_size", F.col("bytes") + 2 * F.octet_length("url") + HEAD_BYTES)
    headers = stored(read.drop("payload"), "headers")
    decided = stored(revisits(headers, min_bytes), "revisits")
    classes = size_classes(record_bytes, file_bytes)
    within = lambda low, top: (F.col("_size") >= low) & (F.col("_size") < top if top else F.lit(True))
    counts = headers.agg(*[F.count_if(within(low, top)).alias(f"c{k}") for k, (low, top, _) in enumerate(classes)]).first()
    for k, (low, top, per_file) in enumerate(classes):
        if counts[k] or not any(counts) and k == 0:
            part = read.filter(within(low, top)).drop("_size")
            records(part, decided).write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", per_file).option(
                "compression", "gzip").text(folder)


def parse(compressed: bytes, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip-compressed archive of one or several members."""
    view, at, unpack, buffer = memoryview(compressed), 0, zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal at, unpack
        if at >= len(view):
            return False
        piece = view[at:at + step]
        at += len(piece)
        buffer.extend(unpack.decompress(piece))
        while unpack.eof and unpack.unused_data:
            rest, unpack = unpack.unused_data, zlib.decompressobj(31)
            buffer.extend(unpack.decompress(rest))
        return True

    while True:
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not more():
                if buffer.strip():
                    raise ValueError("archive ends within a header")
                return
        version, *lines = bytes(buffer[:end]).decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("no WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        stop = end + 4 + int(headers["Content-Length"])
        while len(buffer) < stop + 4:
            if not more():
                raise ValueError("archive ends within a record")
        if buffer[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError("record is longer than it says")
        yield headers, bytes(buffer[end + 4:stop])
        del buffer[:stop + 4]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to` of each record; digests of responses are checked."""
    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for headers, block in parse(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response":
                        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (len(payload), real) != (size, digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                    rows.append((number(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"],
                                 number(headers.get("WARC-Refers-To"))))
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op1_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "archives")
    write_archives(table(spark, folder, "pages"), out)
    return read_archives(spark, out)


ORACLE = """
WITH h AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT page_id, strlen(p)::BIGINT AS n, x, list_transform(range(4), lambda k: ('0x' || x[1+10*k:10+10*k])::UBIGINT) AS v FROM h),
d AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda c:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((v[1 + c // 8] >> (35 - 5 * (c % 8))) & 31)::BIGINT]), '') AS digest FROM g),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS low FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id > low THEN low END AS refers_to FROM f
"""
