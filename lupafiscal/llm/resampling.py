"""Importance resampling towards a target distribution, ranked by parallel sorting by regular sampling.

Features are runs of one to three lower-cased words, hashed into ``BUCKETS``.  The
gain of a bucket is the log ratio of its smoothed shares in the target and in the raw
corpus; a text's weight is the sum of its gains, looked up in one array.  Weights
plus Gumbel noise by id are the scores; the highest are a draw without replacement in
proportion to exp(weight).

Scores are ranked in four steps, and no rows but the samples reach the driver: rows
are sorted where they lie and written as runs; every stride-th row of every run is a
sample, and regular places in the sorted samples are splitters; the rows of a segment
between two splitters are exchanged and merged by sorting; the counts of the segments
before give each segment's first rank.  Rows with equal scores and ids are told apart
by their place, so that a segment can end among them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lupafiscal.llm import words
from lupafiscal.llm.tables import keeping, map_arrow, written

GRAMS = 3
BUCKETS = 10_000
SCALE = 1000
SEED = 42
MIN_WORDS = 20
PERCENT = 5
# Keys that the driver sorts: no more than this, and half a key for each run.
SAMPLE_KEYS = 1 << 14
SEGMENT_ROWS = 4 << 20
# Longer words go through zlib one by one.
_LONG = 64
_ALL = np.uint32(0xFFFFFFFF)
RESULTS = "n_words long, n_features long, weight long"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    return table


CRC_TABLE = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return CRC_TABLE[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))


class _Crc:
    """Registers of the crc32 of many words at a time; words are taken by falling length."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        lengths = ends - starts
        self.data, self.starts, self.ends = data, starts, ends
        self.long = np.flatnonzero(lengths > _LONG)
        lengths = np.where(lengths > _LONG, 0, lengths)
        self.order = np.argsort(-lengths, kind="stable")
        self.first = starts[self.order]
        sizes = np.bincount(lengths, minlength=1)
        self.active = (len(starts) - np.cumsum(sizes))[:-1] if len(sizes) else []

    def through(self, registers: np.ndarray) -> np.ndarray:
        """Each word's register after its bytes, from the given one before them."""
        now = registers[self.order]
        for j, n in enumerate(self.active):
            now[:n] = _step(now[:n], self.data[self.first[:n] + j])
        out = np.empty_like(now)
        out[self.order] = now
        for i in self.long.tolist():
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = zlib.crc32(word, int(registers[i] ^ _ALL)) ^ 0xFFFFFFFF
        return out


def features(texts: words.Texts) -> tuple[words.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words, and for 1, 2 and 3 of them: at which word such a feature ends, and the buckets of these."""
    data = words.LOWER[texts.data]
    own = words.find(words.Texts(texts.first, data, texts.offsets), words.LETTERS_DIGITS)
    n = len(own.starts)
    place = np.arange(n) - np.repeat(own.offsets[:-1], own.counts)
    crc, before, out = _Crc(data, own.starts, own.ends), np.full(n, _ALL, np.uint32), []
    for k in range(GRAMS):
        registers = crc.through(before)
        ends = np.flatnonzero(place >= k)
        out.append((ends, ((registers[ends] ^ _ALL) % np.uint32(BUCKETS)).astype(np.int64)))
        before = np.full(n, _ALL, np.uint32)
        before[1:] = _step(registers[:-1], 0x20)
    return own, out


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all whole texts fall into each bucket; null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts in words.slices(batch.column("t")):
                for _, found in features(texts)[1]:
                    totals += np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[used])], ["bucket", "n"])

    rows = df.select(F.col(text).cast("string").alias("t"))
    counted = map_arrow(rows, count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros(BUCKETS, np.int64)
    for row in counted.collect():  # BUCKETS rows at most
        totals[row.bucket] = row.n
    return totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    own, all_ = float(target.sum() + BUCKETS), float(corpus.sum() + BUCKETS)
    return np.array(
        [math.floor(SCALE * math.log((t + 1.0) * all_ / ((s + 1.0) * own))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weighted(df: DataFrame, gain: np.ndarray, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's ``keep`` columns, ``n_words``, ``n_features`` and ``weight``, the sum of its features' gains.

    Null and empty texts have no words and weigh 0.  Repeated rows come out repeatedly;
    an empty table stays empty; other columns are left out and may have any name; a
    kept one named as a result gives way.
    """
    names, columns, fields = keeping(df, keep, RESULTS)
    rows = df.select(*columns, F.col(text).cast("string").alias("t"))
    results = StructType.fromDDL(RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in words.slices(batch.column("t")):
                own, found = features(texts)
                sums = np.zeros(len(own.starts) + 1, np.int64)
                for ends, buckets in found:
                    sums[ends + 1] += gain[buckets]
                weight = np.diff(np.cumsum(sums)[own.offsets])
                n = sum(np.maximum(own.counts - k, 0) for k in range(GRAMS))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(texts.first, texts.rows) for i in range(len(names))),
                     pa.array(own.counts), pa.array(n), pa.array(weight)],
                    [*(f"k{i}" for i in range(len(names))), *results.fieldNames()],
                )

    return map_arrow(rows, run, StructType([*fields, *results.fields])).toDF(*names, *results.fieldNames())


def score(doc_id: str = "doc_id", weight: str = "weight") -> Column:
    """The weight plus Gumbel noise from the id, in thousandths; a null id counts as an empty one."""
    named = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return F.col(weight) + noise.cast("long")


_PLACE_BITS = 33  # of monotonically_increasing_id: the partition stands above them


def _keys(table: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Bytes that sort as rows do: score falling, id rising and null last, place rising."""
    sign = np.int64(-(1 << 63))
    null = np.asarray(table.column("doc_id").is_null())
    doc_id = table.column("doc_id").fill_null(0).to_numpy()
    out = np.zeros(table.num_rows, [("score", ">i8"), ("null", "u1"), ("doc", ">i8"), ("place", ">i8")])
    out["score"], out["null"] = ~table.column("score").to_numpy() ^ sign, null
    out["doc"], out["place"] = doc_id ^ sign, table.column("place").to_numpy()
    return out.view(f"S{out.itemsize}").ravel()


def splitters(runs: DataFrame, rows: int, segments: int) -> np.ndarray:
    """Keys at regular places of the regular samples of locally sorted runs."""
    stride = max(1, -(-rows // SAMPLE_KEYS))
    at = F.expr(f"place & {(1 << _PLACE_BITS) - 1}")
    found = runs.filter(F.col("eligible") & (at % stride == stride // 2)).select("score", "doc_id", "place").toArrow()
    keys = np.sort(_keys(found))
    return np.unique(keys[[i * len(keys) // segments for i in range(1, segments)]]) if len(keys) else keys


def _with_segments(runs: DataFrame, bounds: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment = np.searchsorted(bounds, _keys(batch), side="right").astype(np.int32)
            segment = pa.array(segment, mask=~batch.column("eligible").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, segment], [*batch.schema.names, "segment"])

    return map_arrow(runs, run, StructType([*runs.schema.fields, StructField("segment", IntegerType())]))


def drawn(df: DataFrame, percent: int = PERCENT, segments: int | None = None) -> DataFrame:
    """All rows of ``df`` (``doc_id`` long, ``score`` long, ``eligible``, others), and ``rank``.

    Of the N eligible rows the floor(percent N / 100) with the highest scores, ties to
    smaller ids, have ranks from 1 on, the others null.  Null ids come after all
    others; rows with equal scores and ids are ranked in any order, each once.  An empty
    table stays empty.  ``segments``: at least how many to exchange, by default as many
    as the session's shuffle partitions.
    """
    spark, columns = df.sparkSession, df.columns
    falling = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    runs = written(df.sortWithinPartitions(*falling).withColumn("place", F.monotonically_increasing_id()), "runs")
    rows = runs.filter("eligible").count()
    wanted = percent * rows // 100
    segments = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = min(SAMPLE_KEYS, max(segments, -(-rows // SEGMENT_ROWS)))
    dealt = _with_segments(runs, splitters(runs, rows, segments))
    sizes = dict(dealt.filter("eligible").groupBy("segment").count().collect())  # a row for each segment
    before, total = [], 0
    for segment in sorted(sizes):
        if total < wanted:
            before.append((segment, total))
        total += sizes[segment]
    last = before[-1][0] if before else -1
    first_ranks = spark.createDataFrame(before, "segment int, before long")
    merged = Window.partitionBy("segment").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "place")
    rank = F.col("before") + F.row_number().over(merged)
    ranked = dealt.filter(F.col("segment") <= last).join(first_ranks, "segment").withColumn("rank", rank)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = dealt.filter(F.col("segment").isNull() | (F.col("segment") > last))
    return ranked.select(*columns, "rank").unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(
    documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """Per row of ``documents``: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``eligible``, ``rank``.

    Both tables are counted whole.  Eligible are texts of ``MIN_WORDS`` words or more.
    See ``weighted`` and ``drawn`` for nulls, repeated rows and empty tables.
    """
    gain = gains(bucket_counts(documents, text), bucket_counts(target, text))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = weighted(rows, gain, keep=("doc_id",)).withColumn("score", score())
    return drawn(found.withColumn("eligible", F.col("n_words") >= MIN_WORDS), percent)
