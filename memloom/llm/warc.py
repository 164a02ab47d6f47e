"""WARC: pages are written as records of WARC/1.1 archives and read back. Long blocks are split into segments;
reading groups continuation records by origin identifier, orders them by segment number, verifies the total
length and decodes chunked transfer framing."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.shared import cut, fields, scratch

#: Bytes of a record's block; a longer one goes on in continuation records.
SEGMENT_BYTES = 32_768
#: Records of one archive file: 128 MiB at most, 10 to 20 MB with pages of usual size.
FILE_RECORDS = 4_000
#: Distinct repeated payloads (28 bytes each) up to which their responses' ids are broadcast; beyond it the join
#: shuffles, and Spark splits a repeated payload that holds a large share of the rows.
BROADCAST_PAYLOADS = 200_000
#: Bytes of one chunk of the chunked transfer framing.
TRANSFER_CHUNK = 4_096

# Fixed values of the WARC/1.1 format.
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 5 hex digits become 4 of base 32, in the alphabet of RFC 4648."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _chunked(body: Column) -> Column:
    """The body in frames of ``TRANSFER_CHUNK`` bytes, each behind its length in hex, and the closing frame."""
    size = F.octet_length(body)
    frames = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / TRANSFER_CHUNK).cast("int")),
        lambda k: F.concat(F.hex(F.least(F.lit(TRANSFER_CHUNK), size - k * TRANSFER_CHUNK)).cast("binary"), F.lit(CRLF).cast("binary"), F.substring(body, k * TRANSFER_CHUNK + 1, TRANSFER_CHUNK), F.lit(CRLF).cast("binary")),
    )
    whole = F.unhex(F.array_join(F.transform(frames, F.hex), ""))
    return F.when(size == 0, F.lit(b"0\r\n\r\n")).otherwise(F.concat(whole, F.lit(b"0\r\n\r\n")))


def write(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Archives of one record (and its continuations) per row, uncompressed, under ``path``.

    Of rows with equal payloads those with the largest page_id are responses and the others revisit them; rows
    that repeat id and payload of a response are responses too. Null html is the empty payload, a null url an
    empty target, a null id the smallest. Spark's text writer sets the blank lines that end a record.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("body"))
    narrow = rows.select("page_id", F.unhex(F.sha1("body")).alias("sha"))
    repeated = cut(narrow.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n"), F.min("page_id").alias("least"), F.count("page_id").alias("known")).where("n > 1 AND (least < top OR known < n)").select("sha", "top"), "warc-repeated")
    if repeated.count() <= BROADCAST_PAYLOADS:
        repeated = F.broadcast(repeated)
    rows = rows.withColumn("sha", F.unhex(F.sha1("body"))).join(repeated, "sha", "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    digest, text = base32_sha1(F.col("body")), lambda *p: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in p))
    http = F.when(revisit, F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n").cast("binary")).otherwise(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n").cast("binary"), _chunked(F.col("body"))))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    rows = rows.select(
        name.alias("name"), "url", digest.alias("digest"), revisit.alias("revisit"), F.col("top").cast("string").alias("top"), F.octet_length("body").alias("n"), http.alias("block"),
        F.monotonically_increasing_id().alias("no"),
    )
    parts = F.greatest(F.lit(1), F.ceil(F.octet_length("block") / segment_bytes)).cast("int")
    rows = rows.withColumn("parts", parts).select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("k"))
    origin = text("<urn:x-page:", F.col("name"), ":", F.col("no").cast("string"), ">")
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")  # no header line breaks
    own = F.substring("block", (F.col("k") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    first, many, last = F.col("k") == 1, F.col("parts") > 1, F.col("k") == F.col("parts")
    maybe = lambda when, *p: F.when(when, text(*p)).otherwise(F.lit(""))
    head = text(
        "WARC/1.1\r\nWARC-Type: ", F.when(~first, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), CRLF,
        "WARC-Record-ID: ", F.when(first, origin).otherwise(text("<urn:x-page:", F.col("name"), ":", F.col("no").cast("string"), ":", F.col("k").cast("string"), ">")), CRLF,
        "WARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: ", target, CRLF,
        maybe(first, "X-Page-ID: ", F.col("name"), CRLF, "WARC-Payload-Digest: sha1:", F.col("digest"), CRLF),
        maybe(first & F.col("revisit"), "WARC-Profile: ", REVISIT_PROFILE, CRLF, "WARC-Refers-To: <urn:x-page:", F.col("top"), ">", CRLF, "X-Payload-Length: ", F.col("n").cast("string"), CRLF),
        maybe(many, "WARC-Segment-Number: ", F.col("k").cast("string"), CRLF),
        maybe(~first, "WARC-Segment-Origin-ID: ", origin, CRLF),
        maybe(many & last, "WARC-Segment-Total-Length: ", F.octet_length("block").cast("string"), CRLF),
        maybe(first, "Content-Type: application/http; msgtype=response\r\n"),
        "Content-Length: ", F.octet_length(own).cast("string"), CRLF, CRLF,
    )
    records = rows.select(F.concat(head.cast("binary"), own).cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(path)


def unchunk(body: bytes) -> bytes:
    """The bytes inside chunked framing; ValueError if it is broken off or malformed."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is broken off")
        out.append(body[at : at + size])
        at += size + 2


def unpacked(data: bytes) -> bytes:
    """An archive without compression: one of gzip members (usually one a record) is inflated up to where it breaks."""
    out = []
    while data.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out) if out else data


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Headers (lower-case names), block and what is wrong with each record, by Content-Length. Ends at the first byte
    that begins no record; a header or block that is broken off, or a header without a length, ends it with an error."""
    data, at = unpacked(data), 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = head.get("content-length", "")
        if end < 0 or not length.isdecimal():
            yield head, b"", "the header is broken off" if end < 0 else f"no length of the block: {length!r}"
            return
        size = int(length)
        block = data[end + 4 : end + 4 + size]
        yield head, block, None if len(block) == size else f"{len(block)} bytes of the block instead of {size}"
        at = end + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


def _payload(head: dict[str, str], block: bytes) -> tuple[bytes | None, str | None]:
    """The HTTP body of a block, and what is wrong with it."""
    top, _, body = block.partition(b"\r\n\r\n")
    try:
        if b"transfer-encoding: chunked" in top.lower():
            body = unchunk(body)
    except ValueError as e:
        return None, f"{e}"
    return body, None


_ROW = "page string, record_type string, refers string, payload binary, said_digest string, said_bytes bigint, error string"
_NAMES = ("page", "record_type", "refers", "payload", "said_digest", "said_bytes", "error")
_KINDS = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string())


def _row(head: dict[str, str], block: bytes, error: str | None = None) -> tuple:
    payload, wrong = _payload(head, block) if error is None else (None, error)
    refers = head.get("warc-refers-to", "").removeprefix("<urn:x-page:").removesuffix(">") or None
    return head.get("x-page-id"), head.get("warc-type"), refers, None if head.get("warc-type") == "revisit" else payload, head.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(head["x-payload-length"]) if head.get("x-payload-length", "").isdecimal() else None, wrong


def read(spark, path: str, files: str = "part-*") -> DataFrame:
    """One row per record set: page, record_type, refers, payload (null for revisits and broken ones),
    said_digest, said_bytes and error.

    Records of one segment are decoded where they are read. Only segments of longer blocks are shuffled, by
    origin identifier; a set whose numbers have a gap or whose length isn't the total length gets an error.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("content")
    wide = fields(_ROW + ", origin string, number int, total bigint, head string, block binary")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*_KINDS, pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for value in batch.column("content"):
                rows, size = [], 0
                for head, block, wrong in records(value.as_buffer().to_pybytes()):
                    origin = head.get("warc-segment-origin-id") or head.get("warc-record-id")
                    if wrong is None and head.get("warc-segment-number", "").isdecimal() and origin:
                        total = head.get("warc-segment-total-length", "")
                        total = total if total.isdecimal() else None
                        number = int(head["warc-segment-number"])
                        rows.append((None,) * 7 + (origin, number, int(total) if total else None, json.dumps(head) if number == 1 else None, block))
                    else:
                        rows.append(_row(head, block, wrong) + (None,) * 5)
                    size += len(block)
                    if size > 8 << 20:
                        yield _batch(rows, kinds, [f.name for f in wide])
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, kinds, [f.name for f in wide])

    parsed = archives.mapInArrow(parse, T.StructType(wide))  # both branches parse the files: cheaper than one more copy
    whole = parsed.where(F.col("origin").isNull()).select(*_NAMES)
    sets = parsed.where(F.col("origin").isNotNull()).groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("head").alias("head")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = b"".join(p["block"] for p in row["parts"])
                error = None
                if [p["number"] for p in row["parts"]] != list(range(1, len(row["parts"]) + 1)):
                    error = "segments are missing or repeated"
                elif row["total"] != len(block):
                    error = f"{len(block)} bytes instead of {row['total']}"
                yield _batch([_row(json.loads(row["head"] or "{}"), block, error)], _KINDS, _NAMES)

    return whole.unionByName(sets.mapInArrow(join, T.StructType(fields(_ROW))))


def _batch(rows: list[tuple], kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back; the query's digest columns. The
    length and digest of a response are computed from the payload that was read; a revisit has those of its
    record's headers, which the writer took from the same payload."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, **options)
    got = read(spark, path)
    kind = pages.schema["page_id"].dataType
    back = lambda c: F.when(F.col(c) != "null", F.col(c).cast(kind))
    revisit = F.col("record_type") == "revisit"
    return got.select(
        back("page").alias("page_id"), F.when(revisit, F.col("said_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("said_digest")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "record_type", back("refers").alias("refers_to"),
    )
