"""WARC archives of pages: written in segments with chunked transfer framing, and put together again.

Writing: pages with equal payloads of ``DEDUP_BYTES`` or more are stored once, by
the smallest page id; the others are revisit records that refer to it.  A record
block longer than ``segment_bytes`` is cut into continuation records.  Spark's
text writer lays the records down with the blank line that ends a WARC record
between them, so the files are plain (gzip-compressed) WARC files, and tasks may
be lost and repeated.

Reading: records are found by their lengths.  Continuation records are grouped by
the record they continue and ordered by segment number; the total length is
verified, then the chunked framing is decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupafiscal.llm.tables import map_arrow

DEDUP_BYTES = 100
CHUNK_BYTES = 4096
SEGMENT_BYTES = 16 << 10
RECORDS_PER_FILE = 2048
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = (
    b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
)
RECORDS = (
    "record_id string, record_type string, page_id long, origin_id string, segment long, "
    "total_length long, refers_to string, payload_digest string, block binary"
)
PAGES = (
    "record_id string, record_type string, page_id long, refers_to string, payload_digest string, payload binary"
)


def chunked(payload: bytes) -> bytes:
    parts = []
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at : at + CHUNK_BYTES]
        parts += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join((*parts, b"0\r\n\r\n"))


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises where the framing is broken or cut off."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(
    record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int
) -> list[bytes]:
    """The records of one page, without the blank line that ends each."""
    target = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
    block = HTTP_HEAD if refers_to else HTTP_HEAD + chunked(payload)
    blocks = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    cut = len(blocks) > 1
    out = [_record([
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
        ("WARC-Profile", PROFILE if refers_to else None), ("WARC-Segment-Number", 1 if cut else None),
        ("Content-Type", "application/http;msgtype=response"),
    ], blocks[0])]
    for number, part in enumerate(blocks[1:], 2):
        out.append(_record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{number}>"), ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if number == len(blocks) else None),
        ], part))
    return out


def with_references(pages: DataFrame) -> DataFrame:
    """Adds payload digest, record id, and the record that a repeated payload refers to (else null).

    Only digests and ids are grouped; the payloads are joined to them once, in a
    join that Spark can split where one payload is very frequent.
    """
    short = F.octet_length("payload") < DEDUP_BYTES
    hashed = pages.withColumn("digest", F.sha2("payload", 256))
    firsts = (
        hashed.filter(~short).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null").select(F.col("digest").alias("shared"), "first")
    )
    own_id = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), "digest")
    joined = hashed.join(firsts, F.col("digest") == F.col("shared"), "left")
    refers = F.concat(F.lit("urn:page:"), F.col("first").cast("string"), F.lit(":"), "digest")
    return joined.withColumn("record_id", own_id).withColumn(
        "refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), refers)
    )


def write(
    df: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write a record (in segments where long) per row to gzip-compressed WARC files in ``folder``.

    A null payload counts as empty, a null url leaves its header out.  A row
    without page id is never referred to.  Rows that repeat the smallest id are
    all responses.  Other columns are left out.
    """
    pages = df.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string").cast("binary"), F.unhex(F.lit(""))).alias("payload"),
    )
    rows = with_references(pages).select("record_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                record_id, target, payload, digest, refers = (x.as_py() for x in row)
                own = page_records(record_id, target, payload, digest, refers, segment_bytes)
                out += own
                size += sum(map(len, own))
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (
        map_arrow(rows, run, "record binary").select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", END).option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)
    )


def parsed(content: bytes) -> Iterator[tuple]:
    """The records of a file, as in ``RECORDS``; raises where a length doesn't fit."""
    if content[:2] == b"\x1f\x8b":
        parts, reader, rest = [], zlib.decompressobj(31), content
        while rest:  # a file may hold several members
            parts.append(reader.decompress(rest))
            rest, reader = reader.unused_data, zlib.decompressobj(31)
        content = b"".join(parts)
    at = 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:head_end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"offset {at}: no record")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = head_end + 4
        end = start + int(fields["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"offset {at}: the length is wrong")
        record_id = fields["warc-record-id"].strip("<>")
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        page = record_id.split(":")[2] if record_id.startswith("urn:page:") else "-"
        yield (
            record_id, fields["warc-type"], None if page == "-" else int(page),
            fields.get("warc-segment-origin-id", "").strip("<>") or record_id if number else None,
            int(number) if number else None, int(total) if total else None,
            fields.get("warc-refers-to", "").strip("<>") or None,
            fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, content[start:end],
        )
        at = end + 4


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, types[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields]
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the files in ``folder``; a task holds a file, whose number of records is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield _batch(list(parsed(content.as_py())), RECORDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return map_arrow(files.select("content"), run, RECORDS)


def reassembled(found: DataFrame) -> DataFrame:
    """Whole response and revisit records from ``records``, with their decoded payloads (``PAGES``).

    Segments that are missing, or do not add up to the stated length, raise.
    Records repeated as a whole come out as often as their first segment occurs:
    equal segments are counted before anything is gathered, so what meets in one
    place is one record's block.  A revisit record's payload is null.
    """
    single = found.filter("segment is null").select(
        "record_id", "record_type", "page_id", "refers_to", "payload_digest",
        F.array(F.struct(F.lit(1).cast("long").alias("segment"), "block", F.lit(None).cast("long").alias("total_length"))).alias("parts"),
        F.lit(1).cast("long").alias("times"),
    )
    first = F.when(F.col("segment") == 1, F.struct("record_type", "page_id", "refers_to", "payload_digest", "n"))
    cut = (
        found.filter("segment is not null")
        .groupBy("origin_id", "segment", "block", "total_length", "record_type", "page_id", "refers_to", "payload_digest")
        .agg(F.count("*").alias("n"))
        .groupBy(F.col("origin_id").alias("record_id"))
        .agg(F.max(first).alias("first"), F.collect_list(F.struct("segment", "block", "total_length")).alias("parts"))
        .select(
            "record_id", "first.record_type", "first.page_id", "first.refers_to", "first.payload_digest",
            "parts", F.col("first.n").alias("times"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for *row, parts, times in zip(*(batch.column(i) for i in range(7)), strict=True):
                row = [x.as_py() for x in row]
                payload = None if row[1] == "revisit" else payload_of(joined(row[0], parts.as_py()))
                out += [(*row, payload)] * (times.as_py() or 0)
                size += len(payload or b"")
                if size > 8 << 20:
                    yield _batch(out, PAGES)
                    out, size = [], 0
            yield _batch(out, PAGES)

    return map_arrow(single.unionByName(cut), run, PAGES)


def joined(record_id: str, parts: list[dict]) -> bytes:
    """The block of one record from its segments; raises unless they are complete."""
    parts = sorted(parts, key=lambda x: x["segment"])
    block = b"".join(x["block"] for x in parts)
    if [x["segment"] for x in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"{record_id}: segments are missing")
    if len(parts) > 1 and parts[-1]["total_length"] != len(block):
        raise ValueError(f"{record_id}: the segments do not add up to the stated length")
    return block


def sized(pages: DataFrame) -> DataFrame:
    """Sizes and SHA-256 digests of the payloads from ``reassembled``, without the payloads."""
    return pages.select(
        "record_id", "record_type", "page_id", F.col("refers_to").alias("refers"),
        F.octet_length("payload").cast("long").alias("own_bytes"), F.sha2("payload", 256).alias("own_digest"),
    )


def resolved(records_sized: DataFrame) -> DataFrame:
    """Per record of ``sized``: page id, size and digest of the full payload, kind, and the page a revisit refers to.

    A revisit takes size and digest from the response it refers to, found by its record id.
    """
    response = records_sized.filter("record_type = 'response'")
    of = response.groupBy(F.col("record_id").alias("of")).agg(
        F.first("page_id").alias("refers_to"), F.first("own_bytes").alias("payload_bytes"),
        F.first("own_digest").alias("payload_digest"),
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = records_sized.filter("record_type = 'revisit'").join(of, F.col("refers") == F.col("of"), "left")
    return response.select(
        "page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(revisits.select(*columns))
