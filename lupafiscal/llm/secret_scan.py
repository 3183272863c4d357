"""Secret scan by patterns and character Markov models, in DataFrame functions alone.

Patterns find assigned values, access keys and hexadecimal strings, with their
places.  Two first-order character models are trained: one of random strings, on
the values the patterns label, and one of ordinary words and identifiers, on what
neither a pattern finds nor is long enough to be judged, both in all documents.
Other long strings are held against both by their pieces of letters and digits, so
that slugs, paths and dotted or dashed names are judged by the words in them.  A
string is a secret too if its mean log-likelihood ratio a character step reaches
the threshold.  All but ``MISSED`` of the held-out random strings reach it, and, as
few strings say little about rare ones, it is ``ERRORS`` standard errors of the
shortest string or more below the mean of their steps; but it is never below the
middle between the means of held-out steps of both kinds.

A text is searched for spans once, and once more for its words; what is kept of it
is its matches and long strings, and counts of character steps.  Places are running
sums in blocks of the root of their number, so a text of very many matches takes
little more than its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lupafiscal.llm.tables import keeping, written

# The patterns.  Runs are maximal, so a least length in the pattern
# finds what dropping short matches leaves.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LENGTH = 6
KINDS = ["assign", "access", "hex", "model"]

LONG_LENGTH = 16
LONG = rf"[A-Za-z0-9+/_-]{{{LONG_LENGTH},}}"
# Of what is neither found by a pattern nor long, so that strings to be judged never train.
WORD = r"[A-Za-z0-9]{2,}"
UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
SYMBOLS = len(ALPHABET)
SMOOTHING = 20.0
UNIFORM = 0.2  # share of a uniform model in each, so that steps neither has seen weigh little
HELD_OUT = 8  # one string in so many, by hash, sets the threshold and does not train
MISSED = 0.01
ERRORS = 2.5
BINS = 100  # of scores, for 1

SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once, also where functions inside ``use`` name it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``combine``, from 0, over an array of non-negative longs.

    An array grown by one element is copied, so it is grown in blocks of the root
    of its length, first within blocks and then over their last results.
    """
    none = F.expr("cast(array() as array<bigint>)")

    def grown(block: Column) -> Column:
        last = lambda so_far: F.coalesce(F.get(so_far, F.size(so_far) - 1), F.lit(0).cast("long"))
        return F.aggregate(block, none, lambda so_far, x: F.array_append(so_far, combine(last(so_far), x)))

    def in_blocks(own: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(own))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(own), size)
        return F.transform(firsts, lambda first: grown(F.slice(own, first, size)))

    def joined(blocks: Column) -> Column:
        ends = grown(F.transform(blocks, lambda block: F.element_at(block, -1)))
        before = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, 1, F.size(ends) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda block, start: F.transform(block, lambda x: combine(start, x))))

    return bound(values, lambda own: F.when(F.size(own) == 0, none).otherwise(bound(in_blocks(own), joined)))


def located(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Places (in characters, end exclusive) of a pattern's matches, leftmost first, none overlapping.

    The lengths of the matches and of what lies between them add up to the places.
    """
    nothing = F.expr(f"cast(array() as {SPAN})")

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        # A gap, and the match after it; the last gap has none.
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, match: (gap + F.length(match)).cast("long"))
        return F.zip_with(running(lengths, lambda x, y: x + y), found, lambda end, match: F.struct(
            (end - F.length(match)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
            (F.regexp_extract(match, pattern, value) if value else match).alias("value"),
        ))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(found, lambda own: F.when(F.size(own) == 0, nothing).otherwise(spans(own)))


def searched(df: DataFrame, text: str, columns: list[Column]) -> DataFrame:
    """Each row's ``columns``, its ``base`` spans and ``long`` strings."""
    rows = df.select(*columns, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    assigned = F.filter(located(t, ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= ASSIGN_LENGTH)
    rows = rows.withColumn("base", F.concat(assigned, located(t, ACCESS, 1), located(t, HEX, 2)))
    return rows.withColumn("long", located(t, LONG, 3)).drop("t")


def steps(strings: DataFrame) -> DataFrame:
    """Counts of neighbouring letters and digits (a, b) in a column ``s`` of strings, trained and ``held`` out apart."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 1))
    pairs = strings.filter(F.length("s") > 1).select("s", held_out("s").alias("held"), at.alias("i"))
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring("s", i, F.lit(1)))
    coded = pairs.select("held", code(F.col("i")).alias("a"), code(F.col("i") + 1).alias("b"))
    return coded.filter("a > 0 and b > 0").groupBy("held", "a", "b").agg(F.count("*").alias("n"))


def at_step(a, b):
    """Place of a step from code ``a`` to code ``b`` (1 to ``SYMBOLS``) in a model's list, from 0."""
    return (a - 1) * SYMBOLS + b - 1


def ratios(random: DataFrame, ordinary: DataFrame) -> tuple[list[float], float, float] | None:
    """The log ratio of the two models for each step, and the least and the greatest threshold; None if one kind has no step to train on.

    At most 2 * SYMBOLS squared counts of each kind arrive.  A kind without held-out
    steps counts towards the thresholds by those it was trained on.
    """
    logs, checks = [], []
    for counted in (random, ordinary):
        trained, held = [0] * SYMBOLS**2, [0] * SYMBOLS**2
        for row in counted.collect():
            (held if row.held else trained)[at_step(row.a, row.b)] = row.n
        if not any(trained):
            return None
        table = []
        for first in range(0, SYMBOLS**2, SYMBOLS):
            line = [n + SMOOTHING / SYMBOLS for n in trained[first : first + SYMBOLS]]
            table += [math.log((1 - UNIFORM) * x / sum(line) + UNIFORM / SYMBOLS) for x in line]
        logs.append(table)
        checks.append(held if any(held) else trained)
    model = [r - o for r, o in zip(*logs, strict=True)]
    means = [sum(n * x for n, x in zip(counts, model, strict=True)) / sum(counts) for counts in checks]
    spread = math.sqrt(sum(n * (x - means[0]) ** 2 for n, x in zip(checks[0], model, strict=True)) / sum(checks[0]))
    return model, sum(means) / 2, means[0] - ERRORS * spread / math.sqrt(LONG_LENGTH - 1)


def held_out(s: str) -> Column:
    return F.pmod(F.xxhash64(s), F.lit(HELD_OUT)) == 0


def trained(found: DataFrame, documents: DataFrame, text: str) -> tuple[list[float], float] | None:
    """The models' ratios and threshold: random strings from all of ``found``, ordinary ones from all texts of ``documents``."""
    random = found.select(F.explode("base.value").alias("s"))
    texts = documents.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    plain = texts.select(F.regexp_replace("t", f"{ASSIGN}|{ACCESS}|{HEX}|{LONG}", " ").alias("t"))
    ordinary = plain.select(F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("s"))
    fitted = ratios(steps(random), steps(ordinary))
    if fitted is None:
        return None
    model, least, greatest = fitted
    return model, max(least, min(greatest, reached(random, model)))


def reached(random: DataFrame, model: list[float]) -> float:
    """The greatest multiple of 1 / BINS that all but MISSED of the held-out strings reach; infinity without any.

    Strings shorter than those to be judged do not count.  One count per bin of scores arrives.
    """
    score = F.floor(mean_ratio(F.col("s"), model) * BINS).alias("bin")
    held = random.filter(held_out("s") & (F.length("s") >= LONG_LENGTH)).select(score)
    counts = {row.bin: row.n for row in held.filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n")).collect()}
    below, total = 0, sum(counts.values())
    for place in sorted(counts):
        below += counts[place]
        if below > MISSED * total:
            return place / BINS
    return math.inf


def mean_ratio(string: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's steps inside its pieces of letters and digits; null if there are none."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    codes = F.transform(F.split(string, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    n = F.length(string) - 1
    pairs = F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.when(
        (a > 0) & (b > 0), F.element_at(table, at_step(a, b) + 1)
    ))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    add = lambda x, y: F.struct(
        (x["total"] + F.coalesce(y, F.lit(0.0))).alias("total"), (x["n"] + y.isNotNull().cast("int")).alias("n")
    )
    return F.aggregate(pairs, start, add, lambda x: F.when(x["n"] > 0, x["total"] / x["n"]))


def untouched(base: Column, long: Column) -> Column:
    """The ``long`` spans, which do not overlap each other, that overlap no ``base`` span.

    In the order of their starts, a base span before a long one reaches into it by
    the greatest end so far, and one after it can only be its next neighbour.
    """
    def apart(spans: Column, reach: Column) -> Column:
        def marked(s: Column, i: Column) -> Column:
            after = F.get(spans, i + 1)
            into = F.coalesce((after["kind"] < 3) & (after["start"] < s["end"]), F.lit(False))
            return F.when((s["kind"] == 3) & (F.get(reach, i) <= s["start"]) & ~into, s)

        return F.filter(F.transform(spans, marked), lambda s: s.isNotNull())

    def compared(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0).cast("long")))
        return bound(running(ends, F.greatest), lambda reach: apart(spans, reach))

    either = (F.size(base) == 0) | (F.size(long) == 0)
    return F.when(either, long).otherwise(bound(F.array_sort(F.concat(base, long)), compared))


def written_spans(spans: Column) -> Column:
    """kind:start:end of spans in the order of start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    ))
    return F.array_join(each, ",")


RESULTS = f"base {SPAN}, added {SPAN}"


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's ``keep`` columns, ``base`` (spans by pattern) and ``added`` (spans by the models).

    A span has start, kind (a number in ``KINDS``), end and value, in characters.
    Added ones touch no base one and have letters, ``LONG_LENGTH`` of them if they
    have no digits: numbers score as random, and ruled lines as nothing.  UUIDs are
    identifiers and not added, and nothing is if the documents have no strings to
    train either model on.  A null or empty text has no spans; an empty table gives
    an empty one; repeated rows come out repeatedly; other columns are left out and
    may have any name; a kept one named as a result gives way.
    """
    names, columns, _ = keeping(df, keep, RESULTS)
    found = written(searched(df, text, columns), "secrets")
    model = trained(found, df, text)

    def is_secret(s: Column) -> Column:
        letters = F.length(F.regexp_replace(s["value"], "[^A-Za-z]", ""))
        judged = (letters >= LONG_LENGTH) | s["value"].rlike("[0-9]") & (letters > 0)
        scores, threshold = model
        return judged & ~s["value"].rlike(UUID) & F.coalesce(mean_ratio(s["value"], scores) >= threshold, F.lit(False))

    if model is None:
        added = F.expr(f"cast(array() as {SPAN})")
    else:
        added = F.when(F.size("long") > 0, F.filter(untouched(F.col("base"), F.col("long")), is_secret)).otherwise(F.col("long"))
    return found.withColumn("added", added).drop("long").toDF(*names, "base", "added")
