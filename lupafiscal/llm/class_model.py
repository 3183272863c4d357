"""Language-model scores by Brown classes: class transitions times word emissions.

A text is its lower-cased words and one end.  Every training word has a class, by
exchange clustering: it moves to the class that raises the likelihood of the class
bigrams most.  Words of ``UNIT_SHARE`` of all training tokens or more, at most
1 / UNIT_SHARE of them, come first: each starts in a class by its frequency and moves
round by round, while all other words stand in ``SHAPES`` units by their last two bytes
and length.  A round looks at one share of the units, each against the same counts, and
a round that doesn't raise the likelihood of all is taken back; so the result does not
depend on how the counts are dealt over tasks.  In a last round every other word, however
rare, leaves its shape for a class of its own choice, by all words before and after it.
Words that no training text has take their shape's class.

Bigrams of units are counted once over all training texts, by partial sums.  The words
around each word of the last round are sorted by it and added up as they stream by.
Counts and classes of words of ``KNOWN_SHARE`` or more are held by the tasks (at most
1 / KNOWN_SHARE of them); those of rarer words are joined, and as none of these is more
frequent than that share, no key of the join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lupafiscal.llm import words
from lupafiscal.llm.tables import map_arrow, written

CLASSES = 64
SHAPES = 1024
UNIT_SHARE = 2**-16
KNOWN_SHARE = 2**-20
# Rounds of the exchange, and how many rounds it takes to look at every unit.
ROUNDS = 16
SHARES = 4
# Pseudo-counts of a class's successors, in proportion to their frequency.
TRANSITION_PRIOR = 16.0
MODULUS, HELD_OUT = 7, 2
END = np.uint64(0x656E64)
_K = CLASSES + 1  # class 0 is the end's own
_U = np.uint64
# Beside a word: the same word.
ITSELF = 255
# Entries whose gains are worked out at once.
GAINS_AT_ONCE = 1 << 14
# Texts whose late words are gathered at once.
CONTEXT_BYTES = words.SLICE_BYTES
# Late words that the driver looks up at once.
LOOKUP = 1 << 16


@dataclass
class Tokens:
    """The tokens of a run of texts, each text's end included, by distinct token."""

    offsets: np.ndarray  # row r has the tokens from offsets[r] up to offsets[r + 1]
    ids: np.ndarray  # of each token, a place in the arrays below
    keys: np.ndarray
    shapes: np.ndarray


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and of each value which one it is."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    ids = np.empty(len(values), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ordered[new], order[new], ids


def tokens(texts: words.Texts) -> Tokens:
    data = words.LOWER[texts.data]
    own = words.find(words.Texts(texts.first, data, texts.offsets), words.NOT_BLANK)
    offsets = own.offsets + np.arange(texts.rows + 1)
    found = np.full(offsets[-1], END, _U)
    is_word = np.ones(offsets[-1], bool)
    is_word[offsets[1:] - 1] = False
    found[is_word] = words.hashes(data, own.starts, own.ends)
    last = np.zeros((3, offsets[-1]), _U)
    if len(own.starts):
        lengths = own.ends - own.starts
        last[0, is_word] = data[own.ends - 1]
        last[1, is_word] = np.where(lengths > 1, data[np.maximum(own.ends - 2, 0)], 0)
        last[2, is_word] = np.minimum(lengths, 15)
    keys, first, ids = _distinct(found)
    shapes = words.mix(last[0, first] | last[1, first] << _U(8) | last[2, first] << _U(16)) % _U(SHAPES)
    return Tokens(offsets, ids, keys, shapes.astype(np.int64))


def prepared(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``t`` and ``held_out``; a null id is not held out."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS == HELD_OUT
    return rows.withColumn("held_out", F.coalesce(out, F.lit(False)))


def vocabulary(rows: DataFrame) -> DataFrame:
    """``word`` (a hash of 64 bits), ``shape`` and count ``n`` of every token of all texts ``t``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in words.slices(batch.column("t")):
                found = tokens(texts)
                n = np.bincount(found.ids, minlength=len(found.keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys.view(np.int64)), pa.array(found.shapes.astype(np.int32)), pa.array(n)], ["word", "shape", "n"]
                )

    counted = map_arrow(rows.select("t"), count, "word long, shape int, n long")
    return counted.groupBy("word").agg(F.max("shape").alias("shape"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What tasks hold of the vocabulary: frequent words by hash, and sizes of the rest by shape."""

    total: int
    distinct: int
    keys: np.ndarray  # sorted
    counts: np.ndarray
    unit: np.ndarray  # 0 for the end, from 1 on for words, -1 for those that go by shape
    n_units: int  # with the end, without shapes

    def units(self, found: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct token the unit and the count, -1 where it isn't held."""
        if not len(self.keys):
            return np.where(found.keys == END, 0, self.n_units + found.shapes), np.full(len(found.keys), -1, np.int64)
        spot = np.minimum(np.searchsorted(self.keys, found.keys), len(self.keys) - 1)
        held = self.keys[spot] == found.keys
        unit = np.where(held, self.unit[spot], -1)
        unit = np.where(unit < 0, self.n_units + found.shapes, unit)
        return np.where(found.keys == END, 0, unit), np.where(held, self.counts[spot], -1)


def lexicon(vocab: DataFrame) -> Lexicon:
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(END)
    # At most 1 / KNOWN_SHARE words can have that share, and the end.
    held = vocab.filter((F.col("n") >= total * KNOWN_SHARE) | (F.col("word") == end)).select("word", "n").toArrow()
    keys, counts = held.column("word").to_numpy().astype(np.int64).view(_U), held.column("n").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    unit = np.full(len(keys), -1, np.int64)
    own = np.flatnonzero((counts >= total * UNIT_SHARE) & (keys != END))
    own = own[np.lexsort((keys[own], -counts[own]))]
    unit[own] = 1 + np.arange(len(own))
    unit[keys == END] = 0
    return Lexicon(int(total), int(distinct), keys, counts, unit, 1 + len(own))


def bigrams(rows: DataFrame, known: Lexicon) -> DataFrame:
    """How often unit ``u`` is followed by unit ``v`` in all texts ``t``; an end precedes every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in words.slices(batch.column("t")):
                found = tokens(texts)
                now = known.units(found)[0][found.ids]
                before = np.concatenate([[0], now[:-1]])  # rows end in the end, so the next one's first follows it
                pairs, n = np.unique(before << 32 | now, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["u", "v", "n"]
                )

    return map_arrow(rows.select("t"), count, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def neighbours(pairs: DataFrame) -> DataFrame:
    """A row for each unit with all units beside it; both are bounded, and so is a row."""
    after = pairs.select(F.col("u").alias("unit"), F.struct(F.lit(True).alias("after"), F.col("v").alias("other"), "n").alias("x"))
    before = pairs.select(F.col("v").alias("unit"), F.struct(F.lit(False).alias("after"), F.col("u").alias("other"), "n").alias("x"))
    return after.unionByName(before).groupBy("unit").agg(F.collect_list("x").alias("beside"))


def _beside(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    lists = batch.column("beside")
    flat = lists.flatten()
    unit = np.repeat(batch.column("unit").to_numpy(), lists.value_lengths().to_numpy())
    return unit, flat.field("after").to_numpy(zero_copy_only=False), flat.field("other").to_numpy(), flat.field("n").to_numpy()


def transitions(beside: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each class is followed by each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(_K * _K, np.int64)
        for batch in batches:
            unit, after, other, n = _beside(batch)
            pairs = classes[unit[after]] * _K + classes[other[after]]
            totals += np.bincount(pairs, weights=n[after], minlength=_K * _K).astype(np.int64)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[used])], ["pair", "n"])

    return _table(map_arrow(beside, count, "pair int, n long"))


def _table(counted: DataFrame) -> np.ndarray:
    out = np.zeros(_K * _K)
    for row in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        out[row.pair] = row.n
    return out.reshape(_K, _K)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """The part of the class bigrams' log-likelihood that classes can change."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def gains(m: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, itself: float) -> np.ndarray:
    """What moving a unit to each class adds to the likelihood, all else as it is.

    ``own``: its class; ``left`` and ``right``: counts by class of other units before
    and after it; ``itself``: how often it follows itself.
    """
    rest = m.copy()
    rest[:, own] -= left
    rest[own, :] -= right
    rest[own, own] -= itself
    # Whichever class the unit is in, its neighbours' classes keep their sizes.
    size = left.sum() + itself
    ins, outs = m.sum(axis=0), m.sum(axis=1)
    ins[own] -= size
    outs[own] -= size
    columns = _xlogx(rest + left[:, None]) - _xlogx(rest)
    lines = _xlogx(rest + right[None, :]) - _xlogx(rest)
    middle = np.diag(rest)
    value = columns.sum(axis=0) - np.diag(columns) + lines.sum(axis=1) - np.diag(lines)
    value += _xlogx(middle + left + right + itself) - _xlogx(middle)
    value -= _xlogx(ins + size) - _xlogx(ins) + _xlogx(outs + size) - _xlogx(outs)
    value -= value[own]
    value[0] = -np.inf
    return value


def proposals(beside: DataFrame, classes: np.ndarray, m: np.ndarray, turn: int) -> list[tuple[int, int]]:
    """The units of this turn's share that gain by moving, and where to."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit").to_numpy()
            due = np.flatnonzero((words.mix(units.astype(_U)) % _U(SHARES) == turn) & (units > 0))
            moved = []
            for i in due.tolist():
                _, after, other, n = _beside(batch.slice(i, 1))
                own, same = int(classes[units[i]]), other == units[i]
                sides = [np.bincount(classes[other[k]], weights=n[k], minlength=_K) for k in (~after & ~same, after & ~same)]
                value = gains(m, own, *sides, float(n[after & same].sum()))
                best = int(value.argmax())
                if value[best] > 1e-6:
                    moved.append((int(units[i]), best))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in moved], pa.int32()) for k in (0, 1)], ["unit", "to"])

    return [(row.unit, row.to) for row in map_arrow(beside, look, "unit int, to int").collect()]  # units at most


def exchange(beside: DataFrame, n_units: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit (shapes last), and the counts of class transitions."""
    classes = np.concatenate([[0], 1 + np.arange(n_units - 1) % CLASSES, 1 + np.arange(SHAPES) % CLASSES])
    m = transitions(beside, classes)
    idle = 0
    for turn in range(rounds):
        moves = proposals(beside, classes, m, turn % SHARES)
        tried = classes.copy()
        for unit, to in moves:
            tried[unit] = to
        counted = transitions(beside, tried) if moves else m
        better = bool(moves) and likelihood(counted) > likelihood(m)
        classes, m, idle = (tried, counted, 0) if better else (classes, m, idle + 1)
        if idle == SHARES:
            break
    return classes, m


def contexts(rows: DataFrame, known: Lexicon, classes: np.ndarray) -> DataFrame:
    """Late words (without a unit of their own), some rows each: ``word``, the class ``own`` of its shape, and ``near``.

    ``near`` has two bytes for each occurrence in the texts ``t``, the classes of what is before and after it.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in words.slices(batch.column("t"), CONTEXT_BYTES):
                found = tokens(texts)
                units = known.units(found)[0]
                own = classes[units].astype(np.uint8)
                late = units >= known.n_units
                now = own[found.ids]
                at = np.flatnonzero(late[found.ids])  # an end follows each
                before = np.where(at > 0, now[at - 1], 0)
                before[(at > 0) & (found.ids[at - 1] == found.ids[at])] = ITSELF
                after = np.where(found.ids[at + 1] == found.ids[at], ITSELF, now[at + 1])
                order = np.argsort(found.ids[at])
                near = np.stack([before[order], after[order]], axis=1).astype(np.uint8)
                bounds = 2 * np.concatenate([[0], np.cumsum(np.bincount(found.ids[at], minlength=len(late))[late])])
                listed = pa.Array.from_buffers(
                    pa.binary(), int(late.sum()), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(near)]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys[late].view(np.int64)), pa.array(own[late].astype(np.int32)), listed], ["word", "own", "near"]
                )

    return map_arrow(rows.select("t"), look, "word long, own int, near binary")


def best_classes(m: np.ndarray, own: np.ndarray, beside: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """Where each of many units goes: as ``gains`` tells of one, but worked out for the classes beside it alone.

    ``beside``: a plane of counts by class before the units, and one after them.
    """
    every = np.arange(len(own))
    flow = (m, m.T)  # by side: the class beside, then the unit's class
    size = (beside[0].sum(axis=1) + itself)[:, None]
    value = np.zeros((len(own), _K))
    for side in (0, 1):
        at, other = np.nonzero(beside[side])
        n = beside[side][at, other]
        for low in range(0, len(at), GAINS_AT_ONCE):
            g, a, k = (x[low : low + GAINS_AT_ONCE] for x in (at, other, n))
            rest = flow[side][a]
            same = np.flatnonzero(a == own[g])
            rest[same] -= beside[1 - side][g[same]]
            rest[same, own[g[same]]] -= itself[g[same]]
            rest[np.arange(len(g)), own[g]] -= k
            gain = _xlogx(rest + k[:, None]) - _xlogx(rest)
            gain[np.arange(len(g)), a] = 0  # within one class: below
            first = np.flatnonzero(np.diff(g, prepend=-1))
            value[g[first]] += np.add.reduceat(gain, first, axis=0)
    both = beside[0] + beside[1] + itself[:, None]
    middle = np.repeat(np.diag(m)[None, :], len(own), axis=0)
    middle[every, own] -= both[every, own]
    value += _xlogx(middle + both) - _xlogx(middle)
    for total in (m.sum(axis=0), m.sum(axis=1)):
        total = np.repeat(total[None, :], len(own), axis=0)
        total[every, own] -= size[:, 0]
        value -= _xlogx(total + size) - _xlogx(total)
    value[:, 0] = -np.inf
    best = value.argmax(axis=1)
    return np.where(value[every, best] > value[every, own] + 1e-6, best, own)


def late_classes(near: DataFrame, m: np.ndarray) -> DataFrame:
    """``word``, its count ``n``, the class ``own`` of its shape and its own ``class`` for every word of ``near``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0, _K)), np.zeros(0))

        def placed(word: np.ndarray, own: np.ndarray, beside: np.ndarray, itself: np.ndarray) -> pa.RecordBatch:
            n = (beside[0].sum(axis=1) + itself).astype(np.int64)
            found = best_classes(m, own, beside, itself)
            columns = [pa.array(word), pa.array(n), pa.array(own.astype(np.int32)), pa.array(found.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, ["word", "n", "own", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            word = np.concatenate([kept[0], batch.column("word").to_numpy()])
            own = np.concatenate([kept[1], batch.column("own").to_numpy()])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            group = (np.cumsum(np.concatenate([[True], word[1:] != word[:-1]])) - 1)[len(kept[0]) :]
            data, bounds = words.buffers(batch.column("near"))
            seen = data[bounds[0] : bounds[-1]].reshape(-1, 2)
            group = np.repeat(group, np.diff(bounds) // 2)
            beside, itself = np.zeros((2, len(first), _K)), np.zeros(len(first))
            beside[:, : len(kept[0])], itself[: len(kept[0])] = kept[2], kept[3]
            for side in (0, 1):
                other = seen[:, side] != ITSELF
                pairs = group[other] * _K + seen[other, side]
                beside[side] += np.bincount(pairs, minlength=len(first) * _K).reshape(-1, _K)
            itself += np.bincount(group[seen[:, 0] == ITSELF], minlength=len(first))
            word, own = word[first], own[first].astype(np.int64)
            # the last one may go on in the next batch
            yield placed(word[:-1], own[:-1], beside[:, :-1], itself[:-1])
            kept = (word[-1:], own[-1:], beside[:, -1:], itself[-1:])
        if len(kept[0]):
            yield placed(*kept)

    together = near.repartition("word").sortWithinPartitions("word")
    return map_arrow(together, look, "word long, n long, own int, class int")


@dataclass
class Dictionary(Lexicon):
    """A lexicon that also finds the classes of words that tasks don't hold, for the driver alone.

    The unit of such a word stands for its class, ``n_units`` and ``SHAPES`` further on.
    """

    late: DataFrame
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def units(self, found: Tokens) -> tuple[np.ndarray, np.ndarray]:
        units, counts = super().units(found)
        blocks = -(-max(self.distinct, 1) // LOOKUP)
        for i in np.flatnonzero(units >= self.n_units).tolist():
            word = int(found.keys[i].astype(np.int64))
            block = word % blocks
            if block not in self.seen:
                got = self.late.filter(F.pmod("word", F.lit(blocks)) == block).select("word", "class").orderBy("word").toArrow()
                self.seen = {block: tuple(got.column(c).to_numpy() for c in ("word", "class"))}
            known, classes = self.seen[block]
            spot = int(np.searchsorted(known, word))
            if spot < len(known) and known[spot] == word:
                units[i] = self.n_units + SHAPES + classes[spot]
        return units, counts


@dataclass
class Words:
    """What tasks need to code texts: the lexicon, each unit's class and that of each word of the lexicon."""

    lexicon: Lexicon
    classes: np.ndarray
    held: np.ndarray


def held_classes(known: Lexicon, classes: np.ndarray, late: DataFrame) -> Words:
    """Of the late words only those that tasks hold are brought to the driver, 1 / KNOWN_SHARE at most."""
    held = classes[np.maximum(known.unit, 0)]
    mine = late.filter(F.col("n") >= known.total * KNOWN_SHARE).select("word", "class").toArrow()
    if mine.num_rows:
        keys = mine.column("word").to_numpy().astype(np.int64).view(_U)
        held[np.searchsorted(known.keys, keys)] = mine.column("class").to_numpy()
    return Words(known, classes, held)


PARTS = "n_tokens long, n_known long, base_score double, coded binary, places binary, rare array<struct<word:long,n:long>>"


def _parts(rows: DataFrame, held: Words) -> DataFrame:
    """Each row with sums over its held words, the class of each token, and its other words with how often and where they occur."""
    known = held.lexicon
    divisor = np.log10(known.total + known.distinct + 1)
    results = StructType.fromDDL(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in words.slices(batch.column("t")):
                found = tokens(texts)
                units, counts = known.units(found)
                of = held.classes[units].astype(np.uint8)
                if len(known.keys):
                    spot = np.minimum(np.searchsorted(known.keys, found.keys), len(known.keys) - 1)
                    of = np.where(counts >= 0, held.held[spot], of).astype(np.uint8)
                logs = np.log10(np.maximum(counts, 0) + 1.0)
                now, starts = of[found.ids], found.offsets[:-1]
                sizes = np.diff(found.offsets)
                sums = np.add.reduceat(logs[found.ids], starts)
                n_known = np.add.reduceat((counts > 0)[found.ids].astype(np.int64), starts)
                rare = np.flatnonzero((counts < 0)[found.ids] & (found.keys != END)[found.ids])
                row = np.searchsorted(found.offsets, rare, "right") - 1
                order = np.argsort(row << 32 | found.ids[rare])
                pairs, n = np.unique((row << 32 | found.ids[rare])[order], return_counts=True)
                word = found.keys[pairs & 0xFFFFFFFF].view(np.int64)
                listed = pa.StructArray.from_arrays([pa.array(word, pa.int64()), pa.array(n, pa.int64())], ["word", "n"])
                bounds = np.searchsorted(pairs >> 32, np.arange(texts.rows + 1)).astype(np.int32)
                places = (rare - starts[row])[order].astype(np.int32)
                limits = 4 * np.searchsorted(row, np.arange(texts.rows + 1))
                own = [batch.column(c).slice(texts.first, texts.rows) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(sizes), pa.array(n_known), pa.array(sums - sizes * divisor), _binary(now, found.offsets),
                     _binary(places, limits), pa.ListArray.from_arrays(pa.array(bounds), listed)],
                    ["doc_id", "held_out", *results.fieldNames()],
                )

    return map_arrow(rows, run, f"doc_id long, held_out boolean, {PARTS}")


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes, cut at the offsets."""
    at, content = pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, at, content])


SUMS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double"
SUM_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]


def coded(rows: DataFrame, held: Words, late: DataFrame) -> DataFrame:
    """Each row with ``n_tokens``, ``n_known``, ``base_score`` and a byte for each token's class, as a table in the shared folder."""
    parts = written(_parts(rows, held).withColumn("d", F.monotonically_increasing_id()), "parts")
    # Words without a count add log10(0 + 1) = 0 to the score and keep their shape's class, so they need not be found.
    found = parts.select("d", F.posexplode("rare").alias("i", "x")).select("d", "i", "x.word", F.col("x.n").alias("times"))
    rare = late.filter(F.col("n") < held.lexicon.total * KNOWN_SHARE).select("word", "n", "class")
    # Spark takes exploded rows for less than they are, and would broadcast them by that.
    sums = found.hint("merge").join(rare, "word").groupBy("d").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more"),
        F.collect_list(F.col("i").cast("long") * 256 + F.col("class")).alias("placed"),
    )
    joined = parts.join(sums, "d", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "coded", "places",
        F.transform("rare", lambda x: x.n).alias("times"), "placed",
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch.column("coded"))
            data, offsets = data[offsets[0] : offsets[-1]].copy(), offsets - offsets[0]
            spots, limits = words.buffers(batch.column("places"))
            spots, limits = np.frombuffer(spots[limits[0] : limits[-1]].tobytes(), np.int32), (limits - limits[0]) // 4
            times, lists = batch.column("times"), batch.column("placed")
            begins = np.concatenate([[0], np.cumsum(times.flatten().to_numpy())])  # of each rare word, its first place
            word = np.concatenate([[0], np.cumsum(times.value_lengths().fill_null(0).to_numpy())])
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            pairs = lists.flatten().to_numpy()
            which = word[row] + (pairs >> 8)
            n = begins[which + 1] - begins[which]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begins[which], n)
            data[np.repeat(offsets[row], n) + spots[place]] = np.repeat(pairs & 255, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], _binary(data, offsets)], [*SUM_NAMES, "coded"])

    return written(map_arrow(joined, place, f"{SUMS}, coded binary"), "coded")


def _steps(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the place of its class after the class before among all pairs of classes; where rows begin."""
    data, offsets = words.buffers(batch.column("coded"))
    now = data[offsets[0] : offsets[-1]].astype(np.int64)
    before = np.concatenate([[0], now[:-1]])  # rows end in the end
    return before * _K + now, offsets - offsets[0]


def followers(texts: DataFrame) -> np.ndarray:
    """How often each class is followed by each in texts ``coded``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(_K * _K, np.int64)
        for batch in batches:
            if batch.num_rows:
                totals += np.bincount(_steps(batch)[0], minlength=_K * _K)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[used])], ["pair", "n"])

    return _table(map_arrow(texts.select("coded"), count, "pair int, n long"))


@dataclass
class Model:
    lexicon: Dictionary
    classes: np.ndarray  # of the units, and of the numbers that stand for late words
    words: Words
    following: np.ndarray  # log10 probability of a class after a class
    base: np.ndarray  # by class, log10 of what a word's count plus 1 is divided by


def _fit(rows: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the texts ``t`` that aren't held out, the late words, and all rows as ``coded``."""
    training = rows.filter("not held_out")
    known = lexicon(written(vocabulary(training), "vocabulary"))
    beside = written(neighbours(written(bigrams(training, known), "bigrams")), "beside")
    classes, before = exchange(beside, known.n_units)
    late = written(late_classes(contexts(training, known, classes), before), "late")
    held = held_classes(known, classes, late)
    texts = coded(rows, held, late)
    m = followers(texts.filter("not held_out"))
    if likelihood(m) < likelihood(before):  # the last round is taken back
        late = late.withColumn("class", F.col("own"))
        held = held_classes(known, classes, late)
        texts = coded(rows, held, late)
        m = followers(texts.filter("not held_out"))
    frequency = (m.sum(axis=0) + 1) / (m.sum() + _K)
    following = np.log10((m + TRANSITION_PRIOR * frequency) / (m.sum(axis=1, keepdims=True) + TRANSITION_PRIOR))
    members = np.bincount(classes[1 : known.n_units], minlength=_K)
    for row in late.groupBy("class").count().collect():  # CLASSES rows at most
        members[row["class"]] += row["count"]
    base = np.log10(m.sum(axis=0) + members + 1)
    base[0] = np.log10(m[:, 0].sum() + 1)  # the end is certain in its class
    found = Dictionary(*(getattr(known, f) for f in Lexicon.__dataclass_fields__), late)
    return Model(found, np.concatenate([classes, np.arange(_K)]), held, following, base), late, texts


def fit(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all texts ``t``, and the words without a unit of their own as a table in the shared folder."""
    model, late, _ = _fit(training.withColumn("held_out", F.lit(False)))
    return model, late


def _scores(texts: DataFrame, model: Model) -> DataFrame:
    step = (model.following - model.base).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pairs, offsets = _steps(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.add.reduceat(step[pairs], offsets[:-1]))],
                                                 [*SUM_NAMES, "steps"])

    divisor = float(np.log10(model.lexicon.total + model.lexicon.distinct + 1))
    counted = F.col("base_score") + F.col("n_tokens") * F.lit(divisor)
    return map_arrow(texts, run, f"{SUMS}, steps double").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.lexicon.total).cast("long").alias("train_tokens"),
        "base_score", (counted + F.col("steps")).alias("score"),
    )


def score(rows: DataFrame, model: Model, late: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row.

    Rows are as from ``prepared``.  Scores are log10 probabilities of the whole text and
    its end.  A word's probability is that of its class after the class before, times
    its count plus 1 among its class's tokens, words and one more for unknown ones.
    A null or empty text is an end alone.  Repeated rows come out repeatedly.  Without
    training texts all counts are 0; an empty table stays empty.
    """
    return _scores(coded(rows, model.words, late), model)


def scored(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents, by a model of those that aren't held out; columns as of ``score``, others are left out."""
    model, _, texts = _fit(prepared(documents, doc_id, text))
    return _scores(texts, model)
