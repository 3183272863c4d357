"""Repeated passages by sparse suffix arrays.

Of a text's suffixes (by words) only those at minimisers are retained: in every
``PASSAGE`` consecutive words, the place whose ``ANCHOR`` words hash lowest,
leftmost on ties.  Each window of ``PASSAGE`` words thus belongs to one retained
suffix, the same one wherever the window occurs, so no repeat is missed.

Suffixes whose anchor occurs in one document alone are dropped by a count.  The
others are sorted by what follows their anchor and, separately, by what precedes
it; common lengths with the neighbours in both orders extend matches right and
left, and tell which windows occur in different documents.  Anchors with many
suffixes are dealt out over several tasks; the windows that stay single there are
then counted over all of them, so nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupafiscal.llm import words
from lupafiscal.llm.decontamination import merged
from lupafiscal.llm.tables import map_arrow, written

PASSAGE = 50
ANCHOR = 20
WIDTH = PASSAGE - ANCHOR + 1  # anchors in a passage
# Suffixes of one anchor that a task sorts together, and that it works on at once.
TOGETHER = 4096
AT_ONCE = 16_384
_U = np.uint64


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the lowest value, leftmost on ties, in each run of ``width``."""
    n = len(values)
    place, span = np.arange(n), 1
    while span * 2 <= width:
        left, right = place[: len(place) - span], place[span:]
        place = np.where(values[left] <= values[right], left, right)
        span *= 2
    rest = width - span
    left, right = place[: n - width + 1], place[rest : n - width + 1 + rest]
    return np.where(values[left] <= values[right], left, right)


def suffixes(word_hashes: np.ndarray, own: words.Words) -> tuple[np.ndarray, ...]:
    """Retained suffixes: anchor hash, row, first window, number of windows, place of the anchor.

    Windows and places are word numbers in the whole slice.
    """
    none = np.zeros(0, np.int64)
    n = len(word_hashes)
    if n < PASSAGE:
        return none.astype(_U), none, none, none, none
    anchors = words.grams(word_hashes, ANCHOR)
    place = _lowest(anchors, WIDTH)
    windows = np.flatnonzero(words.whole(own, PASSAGE))
    if not len(windows):
        return none.astype(_U), none, none, none, none
    at, row = place[windows], own.rows()[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(windows)))
    return anchors[at[first]], row[first], windows[first], counts, at[first]


def _word_hashes(texts: words.Texts) -> tuple[np.ndarray, words.Words]:
    own = words.find(texts, words.NOT_BLANK)
    return words.hashes(texts.data, own.starts, own.ends), own


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``text`` and ``d``, a 64-bit name of both; rows with both alike are one document."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("d", F.xxhash64("doc_id", "text"))


def anchors(rows: DataFrame) -> DataFrame:
    """``h``, ``d`` and ``w`` (first window, as a word number) of every retained suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy()
            for texts in words.slices(batch.column("text")):
                hashes, own = _word_hashes(texts)
                h, row, window, _, _ = suffixes(hashes, own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(d[row + texts.first]), pa.array((window - own.offsets[row]).astype(np.int32))],
                    ["h", "d", "w"],
                )

    return map_arrow(rows.select("d", "text"), run, "h long, d long, w int")


CONTEXTS = "h long, salt int, parts int, d long, w int, n int, at int, context binary"


def contexts(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The suffixes in ``hits`` (d, found: array of w and parts) with the words their windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, found = batch.column("d").to_numpy(), batch.column("found")
            for texts in words.slices(batch.column("text")):
                hashes, own = _word_hashes(texts)
                short = hashes.astype(np.uint32)
                h, row, window, n, place = suffixes(hashes, own)
                w = window - own.offsets[row]
                lists = found.slice(texts.first, texts.rows)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                wanted = np.repeat(np.arange(texts.rows), sizes) << 32 | flat.field("w").to_numpy().astype(np.int64)
                order = np.argsort(wanted)
                wanted, parts = wanted[order], flat.field("parts").to_numpy()[order]
                key = row << 32 | w
                if not len(key) or not len(wanted):
                    continue
                spot = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                kept = np.flatnonzero(wanted[spot] == key)
                parts, of = parts[spot[kept]], d[row[kept] + texts.first]
                salt = words.mix(of.view(_U)) % parts.astype(_U)
                cut = [short[a:b].tobytes() for a, b in zip(window[kept].tolist(), (window + n + PASSAGE - 1)[kept].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[kept].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(parts.astype(np.int32)),
                    pa.array(of), pa.array(w[kept].astype(np.int32)), pa.array(n[kept].astype(np.int32)),
                    pa.array((place - window)[kept].astype(np.int32)), pa.array(cut, pa.binary()),
                ], [field.split()[0] for field in CONTEXTS.split(", ")])

    joined = rows.select("d", "text").join(hits, "d")
    return map_arrow(joined, run, CONTEXTS)


def _sorted(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a matrix of words, and how many words each shares with the one before."""
    width = sides.shape[1]
    order = np.argsort(np.ascontiguousarray(sides.astype(">u4")).view(f"V{4 * width}").ravel().view(f"S{4 * width}"), kind="stable")
    same = sides[order][1:] == sides[order][:-1]
    shared = np.concatenate([[0], np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1)])
    return order, shared


def repeats(d: np.ndarray, n: np.ndarray, at: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """All windows of some suffixes: suffix, number of the window in it, class, and whether its documents differ.

    Windows of a class are equal.  ``at``: the anchor's place in the context.
    """
    m = len(d)
    right, left = np.zeros((m, PASSAGE), np.uint32), np.zeros((m, WIDTH), np.uint32)
    sizes = np.array([len(x) for x in found], np.int64)
    flat, row = np.concatenate(found), np.repeat(np.arange(m), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - at[row]
    after = (column >= 0) & (column < PASSAGE)
    # 0 stands for no word; words keep 31 bits, which is plenty for 50 in a row.
    right[row[after], column[after]] = flat[after] | np.uint32(1)
    before = column < 0
    left[row[before], -column[before] - 1] = flat[before] | np.uint32(1)
    (right_order, right_shared), (left_order, left_shared) = _sorted(right), _sorted(left)
    out: list[tuple[np.ndarray, ...]] = []
    shift = 0
    for reach in range(WIDTH):  # words before the anchor
        own = np.flatnonzero((at >= reach) & (at - n < reach))
        if not len(own):
            continue
        to_right, to_left = np.empty(m, np.int64), np.empty(m, np.int64)
        to_right[right_order] = np.cumsum(right_shared < PASSAGE - reach)
        to_left[left_order] = np.cumsum(left_shared < reach) if reach else 0
        key = to_right[own] * (m + 1) + to_left[own]
        order = np.argsort(key, kind="stable")
        new = np.ones(len(own), dtype=bool)
        new[1:] = np.diff(key[order]) != 0
        starts = np.flatnonzero(new)
        names = d[own][order]
        differ = np.minimum.reduceat(names, starts) != np.maximum.reduceat(names, starts)
        kind = np.cumsum(new) - 1
        out.append((own[order], at[own[order]] - reach, kind + shift, differ[kind]))
        shift += len(starts)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


FOUND = "d long, first int, last int, digest binary"


def _found(batch: pa.Table) -> pa.RecordBatch:
    """Spans of windows that repeat here, and windows to be counted over all parts of their anchor."""
    d, w, n, at = (batch.column(c).to_numpy() for c in ("d", "w", "n", "at"))
    parts = batch.column("parts").to_numpy()
    found = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("context").combine_chunks()]
    suffix, window, kind, differ = repeats(d, n, at, found)
    order = np.lexsort((window[differ], suffix[differ]))
    s, j = suffix[differ][order], window[differ][order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (np.diff(s) != 0) | (np.diff(j) != 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(s)) - 1 if len(s) else begin
    spans = [d[s[begin]], w[s[begin]] + j[begin], w[s[begin]] + j[end] + PASSAGE]
    # Where an anchor is dealt out, each class sends one window, and each single one itself.
    dealt = np.flatnonzero(parts[suffix] > 1)
    _, first = words.first_of(kind[dealt]) if len(dealt) else (None, np.zeros(0, bool))
    dealt = dealt[first | ~differ[dealt]]
    digests = [None] * len(begin) + [
        hashlib.md5(found[a][b : b + PASSAGE].tobytes()).digest()
        for a, b in zip(suffix[dealt].tolist(), window[dealt].tolist(), strict=True)
    ]
    place = w[suffix[dealt]] + window[dealt]
    columns = [np.concatenate([spans[0], d[suffix[dealt]]]), np.concatenate([spans[1], place]), np.concatenate([spans[2], place + PASSAGE])]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int32)), pa.array(digests, pa.binary())],
        ["d", "first", "last", "digest"],
    )


def compared(found: DataFrame) -> DataFrame:
    """Sorts suffixes and compares neighbours; parts of an anchor come whole, many small ones at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            h, salt = batch.column("h").to_numpy(), batch.column("salt").to_numpy()
            if held and size >= AT_ONCE:
                last = (held[-1].column("h")[-1].as_py(), held[-1].column("salt")[-1].as_py())
                other = np.flatnonzero((h != last[0]) | (salt != last[1]))
                if len(other):
                    held.append(batch.slice(0, int(other[0])))
                    yield _found(pa.Table.from_batches(held))
                    batch, held, size = batch.slice(int(other[0])), [], 0
            held.append(batch)
            size += batch.num_rows
        if size:
            yield _found(pa.Table.from_batches(held))

    return map_arrow(found.repartition("h", "salt").sortWithinPartitions("h", "salt"), run, FOUND)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        spans = [
            [{"first": a, "last": b} for a, b in merged([(x["first"], x["last"]) for x in row])]
            for row in batch.column("found").to_pylist()
        ]
        total = [sum(x["last"] - x["first"] for x in row) for row in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column("d"), pa.array(total, pa.int64()), pa.array(spans, kind)], ["of", "n_repeated", "spans"]
        )


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_repeated`` words and ``spans``, ranges of words (first, after the last).

    A word is a run of other than ASCII blanks.  The spans are all words in windows
    of ``PASSAGE`` words that another document has too, overlapping and touching
    windows as one.  Rows with the same id and text are one document; a repeat
    within a document alone does not count.  Null and empty texts have no spans.
    Other columns are left out.
    """
    rows = keyed(df, doc_id, text)
    retained = written(anchors(rows), "anchors")
    shared = retained.groupBy("h").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("k"))
    shared = shared.filter("low <> high").select("h", F.ceil(F.col("k") / TOGETHER).cast("int").alias("parts"))
    hits = retained.join(shared, "h").groupBy("d").agg(F.collect_list(F.struct("w", "parts")).alias("found"))
    found = written(compared(contexts(rows, hits)), "repeats")
    dealt = found.filter("digest is not null")
    again = dealt.groupBy("digest").agg(F.min("d").alias("low"), F.max("d").alias("high")).filter("low <> high")
    spans = found.filter("digest is null").select("d", "first", "last").unionByName(
        dealt.join(again.select("digest"), "digest", "left_semi").select("d", "first", "last")
    )
    spans = spans.distinct().groupBy("d").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    per_document = map_arrow(spans, _merge, "of long, n_repeated long, spans array<struct<first:long,last:long>>")
    joined = rows.select("doc_id", "d").join(per_document, F.col("d") == F.col("of"), "left")
    return joined.select(
        "doc_id", F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<first:long,last:long>>)")).alias("spans"),
    )
