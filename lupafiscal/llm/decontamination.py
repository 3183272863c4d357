"""Benchmark decontamination with an FM-index per training shard.

A shard is one batch of documents in a task.  Words that no test phrase has break
phrases, so the shard's text is its runs of phrase words, each ended by a
separator.  Its index is the Burrows-Wheeler transform in a wavelet matrix, with
every ``SAMPLE``-th suffix position kept.  All phrases are searched backwards at
once; a phrase drops out when its range is empty.  Occurrences are located by
walking to the nearest kept position, and their spans are merged per document.

Nothing is shuffled.  Phrases are sent to the tasks in blocks of bounded size;
further blocks are further passes over the same rows.  Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lupafiscal.llm import words
from lupafiscal.llm.tables import keeping, map_arrow, written

WINDOW = 13
BLOCK_BYTES = 16 << 20
SAMPLE = 16
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


class Phrases:
    """Windows of the items as word numbers, ended at the right, and the items that have each."""

    def __init__(self, items: list[tuple[str, str | None]]):
        numbers: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
            size = min(WINDOW, len(own))
            for at in range(len(own) - size + 1 if own else 0):
                owners.setdefault(tuple(own[at : at + size]), set()).add(item)
        data = [w.encode() for w in numbers]
        ends = np.cumsum([len(w) for w in data], dtype=np.int64)
        starts = ends - np.array([len(w) for w in data], np.int64)
        keys = words.hashes(np.frombuffer(b"".join(data), np.uint8), starts, ends)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], (order + 1).astype(np.int32)
        self.size = len(numbers)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.shortest = int(self.lengths.min()) if owners else 0
        self.symbols = np.zeros((len(owners), WINDOW), np.int32)
        for i, window in enumerate(owners):
            self.symbols[i, WINDOW - len(window) :] = window
        self.owners = [sorted(x) for x in owners.values()]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The phrase word of each hash, or 0."""
        if not self.size:
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.keys, hashes), self.size - 1)
        return np.where(self.keys[at] == hashes, self.numbers[at], 0).astype(np.int32)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; separators (0) sort first and by place, the last symbol is one.

    Each round sorts only the suffixes that are not yet told apart.
    """
    n = len(text)
    zeros = text == 0
    symbols = np.where(zeros, np.cumsum(zeros) - 1, int(zeros.sum()) + text.astype(np.int64))
    order = np.argsort(symbols, kind="stable")
    rank, length = np.empty(n, np.int64), 1
    new = np.ones(n, dtype=bool)
    new[1:] = symbols[order][1:] != symbols[order][:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    while True:
        alone = new & np.append(new[1:], True)
        open_places = np.flatnonzero(~alone)
        if not len(open_places):
            return order
        suffixes = order[open_places]
        key = group[open_places] * n + rank[suffixes + length]
        by_key = np.argsort(key, kind="stable")
        order[open_places], key = suffixes[by_key], key[by_key]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        new[open_places] = first
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[open_places]] = group[open_places]
        length *= 2


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.blocks).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block, low = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.blocks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class FmIndex:
    """Backward search and location in runs of symbols 1..``size``, each ended by 0."""

    def __init__(self, text: np.ndarray, size: int):
        order = suffix_array(text)
        before = text[order - 1]  # the transform; for the first suffix, the last separator
        kept = (order % SAMPLE == 0) | (before == 0)  # walks never pass a separator
        self.kept, self.positions = Bits(kept), order[kept]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        self.levels: list[tuple[int, Bits, int]] = []
        rest = before
        for bit in range(int(size).bit_length() - 1, -1, -1):
            bits = (rest >> bit) & 1 > 0
            self.levels.append((bit, Bits(bits), int(len(bits) - bits.sum())))
            rest = np.concatenate([rest[~bits], rest[bits]])
        self.origin = self._down(np.arange(size + 1), np.zeros(size + 1, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> bit) & 1 > 0, zeros + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the suffixes begin that have the symbol before those up to ``at``."""
        return self.less[symbols] + self._down(symbols, at) - self.origin[symbols]

    def back(self, at: np.ndarray) -> np.ndarray:
        """The place of the suffix that is one symbol longer."""
        symbols, place = np.zeros(len(at), np.int64), at
        for bit, bits, zeros in self.levels:
            one, ones = bits.get(place), bits.rank(place)
            symbols += one.astype(np.int64) << bit
            place = np.where(one, zeros + ones, place - ones)
        return self.less[symbols] + place - self.origin[symbols]

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which phrases occur, and the range of suffixes that begin with each."""
        last = symbols[:, -1]
        which = np.arange(len(symbols))
        low, high = self.less[last], self.less[last + 1]
        done: list[tuple[np.ndarray, ...]] = []
        for column in range(2, symbols.shape[1] + 2):
            alive = high > low
            which, low, high = which[alive], low[alive], high[alive]
            ended = lengths[which] == column - 1
            done.append((which[ended], low[ended], high[ended]))
            which, low, high = which[~ended], low[~ended], high[~ended]
            if not len(which):
                break
            symbol = symbols[which, -column]
            low, high = self.step(symbol, low), self.step(symbol, high)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, steps = np.zeros(len(at), np.int64), 0
        todo = np.arange(len(at))
        while len(todo):
            found = self.kept.get(at)
            out[todo[found]] = self.positions[self.kept.rank(at[found])] + steps
            todo, at = todo[~found], self.back(at[~found])
            steps += 1
        return out


def occurrences(phrases: Phrases, numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word places and window numbers of all occurrences in one shard of words.

    ``numbers``: the phrase word of each word or 0; ``rows``: its document.
    """
    used = np.flatnonzero(numbers)
    none = np.zeros(0, np.int64)
    if not len(used) or not phrases.shortest:
        return none, none
    new = np.ones(len(used), dtype=bool)
    new[1:] = (np.diff(used) > 1) | (np.diff(rows[used]) > 0)
    run = np.cumsum(new) - 1
    sizes = np.bincount(run)
    kept = sizes[run] >= phrases.shortest
    used, sizes = used[kept], sizes[sizes >= phrases.shortest]
    if not len(used):
        return none, none
    ends = np.cumsum(sizes)
    text = np.insert(numbers[used], ends, 0)
    places = np.insert(used, ends, 0)
    index = FmIndex(text, phrases.size)
    which, low, high = index.search(phrases.symbols, phrases.lengths)
    counts = high - low
    begin = np.repeat(low - (np.cumsum(counts) - counts), counts)
    return places[index.locate(np.arange(int(counts.sum())) + begin)], np.repeat(which, counts)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


STATE = (
    "n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>, "
    "removals array<struct<start:long,end:long>>"
)
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_REMOVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(phrases: Phrases, column: pa.Array, found: list[tuple[list, list]]) -> tuple[list, ...]:
    """n_words, n_hit, items, spans (in words) and removals (in characters) of each text.

    ``found``: items and spans that earlier blocks have found.
    """
    numbers, rows, counts, bounds = [], [], [], []
    for texts in words.slices(column):
        lower = words.LOWER[texts.data]
        own = words.find(words.Texts(texts.first, lower, texts.offsets), words.LETTERS_DIGITS)
        numbers.append(phrases.number(words.hashes(lower, own.starts, own.ends)))
        rows.append(own.rows() + texts.first)
        counts.append(own.counts)
        shift = texts.offsets[:-1][own.rows()]
        bounds.append(np.stack([own.starts - shift, own.ends - shift]))
    n_words = np.concatenate(counts)
    before = np.cumsum(n_words) - n_words
    row_of, bounds = np.concatenate(rows), np.concatenate(bounds, axis=1)
    at, window = occurrences(phrases, np.concatenate(numbers), row_of)
    hits: dict[int, tuple[set, list]] = {r: (set(i), list(s)) for r, (i, s) in enumerate(found) if s}
    if len(at):
        row = row_of[at]
        first = at - before[row]
        for r, f, w in zip(row.tolist(), first.tolist(), window.tolist(), strict=True):
            items, spans = hits.setdefault(r, (set(), []))
            items.update(phrases.owners[w])
            spans.append((f, f + int(phrases.lengths[w])))
    out = ([*map(int, n_words)], [0] * len(n_words), [[]] * len(n_words), [[]] * len(n_words), [[]] * len(n_words))
    for r, (items, spans) in hits.items():
        spans = merged(spans)
        data = np.frombuffer(column[r].as_buffer(), np.uint8)
        chars = words.char_positions(data)
        ends = bounds[:, before[r] : before[r] + n_words[r]]
        out[1][r] = sum(b - a for a, b in spans)
        out[2][r] = sorted(items)
        out[3][r] = [{"first": a, "last": b} for a, b in spans]
        out[4][r] = [{"start": int(chars[ends[0, a]]), "end": int(chars[ends[1, b - 1]])} for a, b in spans]
    return out


def phrase_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[int, Callable[[int], Phrases]]:
    """How many blocks of about ``BLOCK_BYTES`` of text the benchmark has, one at least, and what gives the phrases of one.

    A null id counts as the empty string; items of one id are one item.  Only the
    block asked for comes to the driver.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_BYTES))

    def phrases(block: int) -> Phrases:
        own = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        return Phrases([(row.i or "", row.t) for row in own.collect()])

    return blocks, phrases


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's ``keep`` columns and what of it the benchmark has (``STATE``).

    A word is a run of digits, a-z and characters beyond ASCII after A-Z are
    lower-cased.  A phrase is ``WINDOW`` words of an item, or a shorter item as a
    whole; an item without words has none.  ``n_hit``: words in any occurrence;
    ``items``: ids, in order; ``spans``: merged word ranges; ``removals``: the same
    in characters.  Null and empty texts have no words.  Repeated rows come out
    repeatedly; other columns are left out and may have any name; a kept one named
    as a result gives way.
    """
    names, columns, fields = keeping(df, keep, STATE)
    state = StructType.fromDDL(STATE)
    schema = StructType([*fields, StructField("t", StringType()), *state.fields])
    rows = df.select(*columns, F.col(text).cast("string").alias("t"))
    blocks, phrases = phrase_blocks(benchmark)
    for block in range(blocks):
        rows = map_arrow(rows, _pass(phrases(block), len(names), first=block == 0), schema)
        if block < blocks - 1:
            rows = written(rows, "decontamination")
    return rows.drop("t").toDF(*names, *state.fieldNames())


def _pass(phrases: Phrases, kept: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("t")
            known = [([], [])] * batch.num_rows if first else [
                (items, [(s["first"], s["last"]) for s in spans])
                for items, spans in zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist(), strict=True)
            ]
            n_words, n_hit, items, spans, removals = _found(phrases, column, known)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(kept)), column, pa.array(n_words, pa.int64()),
                 pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, _SPANS), pa.array(removals, _REMOVALS)],
                [*(f"k{i}" for i in range(kept)), "t", "n_words", "n_hit", "items", "spans", "removals"],
            )

    return run


def contaminated():
    """Whether a twentieth of a document's words or more are in phrases (over the columns of ``find``)."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without(text, removals):
    """The text without the ranges that ``find`` gives."""
    size = F.char_length(text)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(removals, lambda r: r["end"]))
    ends = F.concat(F.transform(removals, lambda r: r["start"]), F.array(size.cast("long")))
    parts = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(text.isNotNull(), F.array_join(parts, ""))
