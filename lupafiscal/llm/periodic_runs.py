"""Periodic runs of words, as maximal pairs from the tree of LCP intervals.

A run is a stretch with a smallest period q, of ``LEAST`` words and ``TIMES`` periods
at least, that no neighbouring word extends.  Words at i and i + q that stay equal
for n words, with other words (or an end) before and behind, are a maximal pair; the
run is its n + q words, so nothing is left to extend.

Such a pair shares ``ANCHOR`` words at least, so only suffixes whose first ``ANCHOR``
words recur in their text are sorted.  Their LCP intervals are worked through from
the bottom up.  At an interval of n shared words a run is a pair of suffixes from
different children, next to each other in the text (another one between them would
be a smaller period), ``n >= (TIMES - 1) q`` apart at most, with different words
before: of different left classes.  Of each interval's children only those but the
largest are handed up, so a text of m words takes m log m steps, however its words
repeat.  Pairs of neighbours in all intervals along one such path come from one scan
by place, as an interval's own members are those that joined it before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lupafiscal.llm import words
from lupafiscal.llm.tables import keeping, map_arrow

LEAST = 6
TIMES = 4
# Shared words of the shortest pair: n + q >= LEAST and n >= (TIMES - 1) q.
ANCHOR = min(max(LEAST - q, (TIMES - 1) * q) for q in range(1, LEAST + 1))
RUNS = "array<struct<start:long,length:long,period:long>>"
RESULTS = f"n_words long, runs {RUNS}, collapsed string"
_U = np.uint64


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """The rank of each row of some columns, first column first; equal rows have equal ranks."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for column in columns:
        new[1:] |= column[order[1:]] != column[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _suffixes(ids: np.ndarray, row: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the suffixes that share ``ANCHOR`` words with another of their text, sorted, and each one's group.

    ``end``: for each word, the end of its row.  Groups are pieces of the order within which ``ANCHOR`` words are shared.
    """
    n = len(ids) - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none
    inside = np.flatnonzero(np.arange(n) + ANCHOR <= end[:n])
    keys = words.grams(words.mix(ids.astype(_U)), ANCHOR)[inside]
    times, _ = words.first_of(words.mix(keys ^ words.mix(row[inside].astype(_U))))
    kept = inside[times > 1]
    if not len(kept):
        return none, none
    # Ranks by ANCHOR words, then by twice as many, and so on, of the suffixes and of what follows their anchors.
    places = np.union1d(kept, kept[kept + ANCHOR < end[kept]] + ANCHOR)
    columns = []
    for j in range(ANCHOR):
        at = places + j
        here = at < end[places]
        columns.append(np.where(here, ids[np.where(here, at, 0)], -1))
    rank = _dense([row[places], *columns])
    spot = np.full(len(ids) + 1, -1, np.int64)
    spot[places] = np.arange(len(places))
    first = rank[spot[kept]]
    known = ANCHOR
    while True:
        sizes = np.bincount(rank)
        open_ = np.flatnonzero(sizes[rank] > 1)
        if not len(open_):
            break
        ahead = places[open_] + known
        there = ahead < end[places[open_]]
        follow = np.where(there, spot[np.where(there, ahead, len(ids))], -1)
        second = np.where(follow >= 0, rank[follow], -1)
        # Ranks as first places of groups leave room for those inside.
        begins = np.concatenate([[0], np.cumsum(sizes)])
        order = np.lexsort((second, rank[open_]))
        a, b = rank[open_][order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts_group = np.ones(len(order), bool)
        starts_group[1:] = a[1:] != a[:-1]
        head = np.maximum.accumulate(np.where(starts_group, np.arange(len(order)), 0))
        piece = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        moved = begins[rank]
        moved[open_[order]] = begins[a] + piece - head
        rank, known = moved, known * 2
    order = np.argsort(rank[spot[kept]], kind="stable")
    return kept[order], first[order]


def _shared(ids: np.ndarray, end: np.ndarray, suffixes: np.ndarray, group: np.ndarray) -> list[int]:
    """How many words each suffix shares with the one before it in the order; -1 where a group begins."""
    before = np.full(len(ids), -1, np.int64)
    joined = np.flatnonzero(group[1:] == group[:-1]) + 1
    before[suffixes[joined]] = suffixes[joined - 1]
    word, last, other = ids.tolist(), end.tolist(), before.tolist()
    out, have, previous = {}, 0, -2
    for i in np.sort(suffixes[joined]).tolist():
        j = other[i]
        # What the suffix one word earlier shares, less that word, is shared here too.
        have = max(have - 1, ANCHOR) if i == previous + 1 else ANCHOR
        room = last[i] - max(i, j)
        while have < room and word[i + have] == word[j + have]:
            have += 1
        out[i], previous = have, i
    return [out.get(i, -1) for i in suffixes.tolist()]


_FIRST = 1 << 62  # where the members of a path's lowest child joined


def _paths(suffixes: list[int], shared: list[int]) -> tuple[np.ndarray, ...]:
    """Members of the paths of largest children: path, place, shared words where it joined, child it came with."""
    path: list[int] = []
    place: list[int] = []
    joined: list[int] = []
    child: list[int] = []
    children = paths = 0

    def close(member: list[list[int]]) -> None:
        nonlocal paths
        if len(member[0]) > 1:
            path.extend([paths] * len(member[0]))
            place.extend(member[0])
            joined.extend(member[1])
            child.extend(member[2])
            paths += 1

    def hand_up(depth: int, large: list[list[int]], small: list[list[int]]) -> list[list[int]]:
        """One interval's members so far, joined with those of a child."""
        nonlocal children
        if len(large[0]) < len(small[0]):
            large, small = small, large
        close(small)
        children += 1
        large[0].extend(small[0])
        large[1].extend([depth] * len(small[0]))
        large[2].extend([children] * len(small[0]))
        return large

    stack: list[tuple[int, list[list[int]]]] = []  # open intervals: shared words, members
    top: list[list[int]] = [[], [], []]
    for i, n in zip([*suffixes, -1], [*shared, -1], strict=True):
        while stack and stack[-1][0] > n:
            depth, members = stack.pop()
            top = hand_up(depth, members, top)
        if n < 0:
            close(top)
            top = [[i], [_FIRST], [0]]
            continue
        if stack and stack[-1][0] == n:
            stack[-1] = (n, hand_up(n, stack[-1][1], top))
        else:
            stack.append((n, top))
        top = [[i], [_FIRST], [0]]
    return tuple(np.array(x, np.int64) for x in (path, place, joined, child))


def _neighbours(path: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (member, nearest one on one side that was there when it joined) of paths sorted by place."""
    low: list[int] = []
    high: list[int] = []
    stack: list[int] = []
    paths, depths = path.tolist(), joined.tolist()
    for k, depth in enumerate(depths):
        if k and paths[k] != paths[k - 1]:
            stack = []
        while stack:
            other = stack[-1]
            low.append(other)
            high.append(k)
            if depths[other] > depth:  # there before, and nearer than all further ones
                break
            stack.pop()
            if depths[other] == depth:
                break
        stack.append(k)
    return np.array(low, np.int64), np.array(high, np.int64)


def runs(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, length and period of every run, by row, start and period; starts count from their row's."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = np.repeat(offsets[1:], np.diff(offsets))
    none = np.zeros(0, np.int64)
    suffixes, group = _suffixes(ids, row, end)
    if not len(suffixes):
        return none, none, none, none
    path, place, joined, child = _paths(suffixes.tolist(), _shared(ids, end, suffixes, group))
    order = np.lexsort((place, path))
    path, place, joined, child = path[order], place[order], joined[order], child[order]
    low, high = _neighbours(path, joined)
    shared = np.minimum(joined[low], joined[high])
    period = place[high] - place[low]
    same_child = (joined[low] == joined[high]) & (child[low] == child[high])
    fits = ~same_child & (shared >= (TIMES - 1) * period) & (shared + period >= LEAST)
    low, high, shared, period = low[fits], high[fits], shared[fits], period[fits]
    # The left class of a suffix is the word before it; a row's first suffix is a class of its own.
    a, b = place[low], place[high]
    differ = (a == offsets[row[a]]) | (ids[a - 1] != ids[b - 1])
    a, period, length = a[differ], period[differ], (shared + period)[differ]
    # Children of one interval may meet in turns; of pairs with the same words the nearest two count.
    order = np.lexsort((period, length, a))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(length[order]) != 0)
    order = order[new]
    order = order[np.lexsort((period[order], a[order]))]
    return row[a[order]], (a - offsets[row[a]])[order], length[order], period[order]


def _joined(data: np.ndarray, own: words.Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the kept words, a blank between those of one row, and where each row begins."""
    rows = own.rows()[kept]
    last = np.ones(len(kept), bool)
    last[:-1] = rows[1:] != rows[:-1]
    lengths = own.ends[kept] - own.starts[kept] + ~last
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(total[-1]) + np.repeat(own.starts[kept] - total[:-1], lengths)
    out = data[np.minimum(at, max(len(data) - 1, 0))]
    out[total[1:][~last] - 1] = 0x20
    sizes = np.bincount(rows, weights=lengths, minlength=len(own.offsets) - 1).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(sizes)])


def found_in(texts: words.Texts) -> list[pa.Array]:
    """The columns of ``RESULTS`` for each row."""
    own = words.find(texts, words.NOT_BLANK)
    _, ids = np.unique(words.hashes(texts.data, own.starts, own.ends), return_inverse=True)
    row, start, length, period = runs(ids, own.offsets)
    n = len(own.starts)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, own.offsets[row] + start + period, 1)
    np.add.at(cover, own.offsets[row] + start + length, -1)
    data, at = _joined(texts.data, own, np.flatnonzero(np.cumsum(cover)[:n] == 0))
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    bounds = np.searchsorted(row, np.arange(texts.rows + 1)).astype(np.int32)
    collapsed = pa.Array.from_buffers(
        pa.large_utf8(), texts.rows, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]
    )
    return [pa.array(own.counts), pa.ListArray.from_arrays(pa.array(bounds), spans), collapsed.cast(pa.utf8())]


def collapse(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's ``keep`` columns, ``n_words``, its ``runs`` and its ``collapsed`` text.

    A word is a run of other than ASCII blanks, told apart from others by 64 bits.
    Runs have a start (word number, from 0), a length and a smallest period, and come
    by start, then period.  The collapsed text has the words that no run contains
    after its first period, with a blank between them.  Null and empty texts have no
    words, no runs and an empty collapsed text; repeated rows come out repeatedly; an
    empty table stays empty; other columns are left out and may have any name; a kept
    one named as a result gives way.  A row is worked on by one task, with memory in
    proportion to its text.
    """
    names, columns, fields = keeping(df, keep, RESULTS)
    rows = df.select(*columns, F.col(text).cast("string").alias("t"))
    results = StructType.fromDDL(RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in words.slices(batch.column("t")):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(texts.first, texts.rows) for i in range(len(names))), *found_in(texts)],
                    [*(f"k{i}" for i in range(len(names))), *results.fieldNames()],
                )

    return map_arrow(rows, run, StructType([*fields, *results.fields])).toDF(*names, *results.fieldNames())


def longest(found: str = "runs") -> Column:
    """The run of greatest length, then of smallest start, then of smallest period; null without runs."""
    return F.expr(
        f"""aggregate({found}, cast(null as struct<start:long,length:long,period:long>), (best, r) ->
            case when best is null or r.length > best.length then r else best end)"""
    )


def with_planted_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``text``, some texts made periodic from a word on, as the query's contract lays down.

    h is the crc32 of the decimal id, g = floor(h / 10).  Where h is divisible by ten
    and the text has n > 0 words, word i from a = g % n on becomes word
    a + (i - a) % p of the text, p = 1 + floor((n - a) / (3 + g % 8)), and words are
    joined by one space.  Texts of null ids, and all others, stay as they are.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # The words are bound to a name by a list of one, so that they are split once.
    made = r"""transform(array(filter(split(text, '[ \\t-\\r]+'), x -> x <> '')), w ->
        case when size(w) > 0 then
            array_join(transform(sequence(0, size(w) - 1), i -> w[cast(case when i < g % size(w) then i
                else g % size(w) + (i - g % size(w)) % (1 + (size(w) - g % size(w)) div (3 + g % 8)) end as int)]), ' ')
        else text end)[0]"""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = rows.withColumn("h", hashed).withColumn("g", F.expr("h div 10"))
    return chosen.select("doc_id", F.when(F.col("h") % 10 == 0, F.expr(made)).otherwise(F.col("text")).alias("text"))
