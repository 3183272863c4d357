"""Token ids of documents in framed binary files, with an offset index beside them.

A file is a row of records.  A record is

    length of the payload   8 bytes, little-endian
    masked crc32 of the length bytes   4 bytes
    payload
    masked crc32 of the payload   4 bytes
    a line feed

and a payload is one flag byte (1: has an id), the document id (8 bytes, signed)
and the token ids, 2 bytes each where the vocabulary allows it, else 4.  The
checksum mask rotates by 15 bits and adds a constant, so that a checksum stored
inside checksummed data does not weaken it.

Files are written by Spark's own writer, in ascending document order, so tasks
may be lost and repeated.  They are bounded by bytes and by records: a task's
``FILE_BYTES`` go to a folder ``chunk=N`` of their own.  The index has a row per record (file, offset, length,
document, tokens before it), so that a loader can read records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lupafiscal.llm import bpe, words
from lupafiscal.llm.tables import map_arrow

MASK_DELTA = 0xA282EAD8
RECORDS_PER_FILE = 16_384
# A file is read as a whole by one task; a longer record is a file of its own.
FILE_BYTES = 64 << 20
_HEAD = struct.Struct("<QI")
_DOCUMENT = struct.Struct("<Bq")
_CRC = struct.Struct("<I")
TERMINATOR = b"\n"

INDEX = (
    "path string, record long, offset long, length long, doc_id long, "
    "n_tokens long, tokens_before long, ids_crc32 long"
)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record without its line feed."""
    payload = _DOCUMENT.pack(doc_id is not None, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _CRC.pack(masked(length)), payload, _CRC.pack(masked(payload))))


def records(content: bytes) -> Iterator[tuple[int, int, int | None, memoryview]]:
    """Offset, length, document id and ids of each record; raises where a checksum or mark is wrong."""
    view, at = memoryview(content), 0
    while at < len(view):
        length, crc = _HEAD.unpack_from(view, at)
        if crc != masked(view[at : at + 8]):
            raise ValueError(f"offset {at}: wrong checksum of the length")
        payload = view[at + 12 : at + 12 + length]
        end = at + 12 + length
        if masked(payload) != _CRC.unpack_from(view, end)[0] or view[end + 4 : end + 5] != TERMINATOR:
            raise ValueError(f"offset {at}: wrong checksum of the payload")
        known, doc_id = _DOCUMENT.unpack_from(payload)
        yield at, end + 5 - at, doc_id if known else None, payload[_DOCUMENT.size :]
        at = end + 5


def width(path: str, end_id: int) -> int:
    return 2 if max(len(bpe.token_texts(path)) - 1, end_id) < 1 << 16 else 4


def write(
    df: DataFrame, folder: str, path: str, end_id: int,
    doc_id: str = "doc_id", text: str = "text", records_per_file: int = RECORDS_PER_FILE,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write each row's token ids and ``end_id`` to framed files in ``folder``.

    Rows go by ascending document id, nulls first; rows with the same id are all
    written, in the order of their texts' hashes, by several tasks if they are many.
    A null text counts as empty; an empty table leaves no files.
    Texts are ordered before they are encoded, so the sampling for the order
    never encodes anything.  Other columns are left out.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    rows = rows.withColumn("tie", F.xxhash64("t")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("d", "tie", "place").sortWithinPartitions("d", "tie", "t").drop("tie", "place")
    kind = np.uint16 if width(path, end_id) == 2 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.library_encoder(path)
        last = np.array([end_id], kind).tobytes()
        place, chunk, filled = 0, 0, 0
        for batch in batches:
            ids = batch.column("d").to_pylist()
            for texts in words.slices(batch.column("t")):
                flat, at = encoder.ids(texts)
                content, limits = flat.astype(kind).tobytes(), (at * kind().itemsize).tolist()
                own = ids[texts.first : texts.first + texts.rows]
                framed = [
                    frame(d, content[a:b] + last) for d, a, b in zip(own, limits, limits[1:], strict=False)
                ]
                chunks = []
                for record in framed:
                    if filled and filled + len(record) + 1 > file_bytes:
                        chunk, filled = chunk + 1, 0
                    filled += len(record) + 1
                    chunks.append(chunk)
                places = np.arange(place, place + len(framed))
                place += len(framed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(framed, pa.binary()), pa.array(chunks, pa.int32()), pa.array(places, pa.int64())],
                    ["record", "chunk", "place"],
                )

    # The rows are in this order already; the writer has to know it.
    (
        map_arrow(rows, run, "record binary, chunk int, place long")
        .sortWithinPartitions("chunk", "place")
        .select(F.col("record").cast("string").alias("value"), "chunk")
        .write.partitionBy("chunk")
        .option("lineSep", TERMINATOR.decode())
        .option("maxRecordsPerFile", records_per_file)
        .text(folder)
    )


def scan(spark: SparkSession, folder: str, path: str, end_id: int) -> DataFrame:
    """A row per record of the files in ``folder``: the index, with the crc32 of the ids as 32-bit numbers."""
    kind = np.uint16 if width(path, end_id) == 2 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                found, before = [], 0
                for i, (offset, length, doc, raw) in enumerate(records(content.as_buffer())):
                    ids = np.frombuffer(raw, kind)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    found.append((i, offset, length, doc, len(ids), before, crc))
                    before += len(ids)
                columns = list(zip(*found, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(found), pa.string()), *(pa.array(c, pa.int64()) for c in columns)],
                    [field.split()[0] for field in INDEX.split(", ")],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return map_arrow(files.select("path", "content"), run, INDEX)


def write_index(spark: SparkSession, folder: str, index_folder: str, path: str, end_id: int) -> DataFrame:
    """Scan the files once, write the offset index and return it as read back."""
    scan(spark, folder, path, end_id).write.parquet(index_folder)
    return spark.read.schema(INDEX).parquet(index_folder)


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``: the tokens of all documents before, in the order of the files.

    Files hold ascending document ranges, so a running sum over one row per file
    is enough; only these few rows meet in one task.
    """
    files = index.groupBy("path").agg(
        F.sum("n_tokens").alias("in_file"), F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"), F.bool_or(F.col("doc_id").isNull()).alias("no_id"),
    )
    order = Window.orderBy(F.desc("no_id"), F.asc_nulls_first("low"), F.asc_nulls_first("high"), "path")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("path", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("file_start"))
    return index.join(starts, "path").withColumn("start", F.col("file_start") + F.col("tokens_before"))


def read_records(spark: SparkSession, index: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id`` and ``ids`` of the records in ``index``, by their places in the files: any subset, any order.

    A task holds one file; places with a wrong checksum raise.
    """
    kind = np.uint16 if width(path, end_id) == 2 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column("content"), batch.column("places"), strict=True):
                view = memoryview(content.as_buffer())
                found = [next(records(view[x["offset"] : x["offset"] + x["length"]])) for x in places.as_py()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[2] for x in found], pa.int64()),
                     pa.array([np.frombuffer(x[3], kind).astype(np.int32) for x in found], pa.list_(pa.int32()))],
                    ["doc_id", "ids"],
                )

    wanted = index.groupBy("path").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    folder = index.select("path").limit(1).collect()
    if not folder:
        return spark.createDataFrame([], "doc_id long, ids array<int>")
    files = spark.read.format("binaryFile").load(folder[0].path.rpartition("/chunk=")[0]).select("path", "content")
    placed = files.join(wanted, "path").select("content", "places")
    return map_arrow(placed, run, "doc_id long, ids array<int>")
