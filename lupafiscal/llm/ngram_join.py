"""N-gram Jaccard join by MinHash banding.

Texts with the same set of word shingles are one class.  Classes that agree on a
band of MinHash values are candidates; the numbers of bands and rows follow from
the wanted recall.  Only band hashes and class numbers are shuffled for that.
Candidates are gathered into groups (components of the candidate graph), which
hold every pair that shares a band, and the shingles of a class travel to its
group once.  A large group is cut into blocks; each task verifies one pair of
blocks on the full shingle sets, exactly, and returns a row per class: its number
of links and the component it sees.  Pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupafiscal.llm import words
from lupafiscal.llm.components import components
from lupafiscal.llm.tables import map_arrow, written

SHINGLE = 5
# Similarity from which two texts are linked, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
RECALL = 0.9999
MAX_HASHES = 200
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1 << 20
# Shingles in this many classes of a block or more are multiplied as dense columns.
DENSE_FROM = 16
_U = np.uint64


def bands_for(similarity: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) that reach ``recall`` at ``similarity``."""
    best = (1, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


BANDS, ROWS = bands_for(NUMERATOR / DENOMINATOR, RECALL, MAX_HASHES)


def shingle_sets(texts: words.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, in order, end to end; where each row's begin.

    Words are runs of other than ASCII blanks, A-Z lower-cased.  A text of fewer
    than ``SHINGLE`` words, but not none, is one shingle.
    """
    lower = words.LOWER[texts.data]
    own = words.find(words.Texts(texts.first, lower, texts.offsets), words.NOT_BLANK)
    hashes, rows = words.hashes(lower, own.starts, own.ends), own.rows()
    keys = words.grams(hashes, SHINGLE)
    whole = np.flatnonzero(words.whole(own, SHINGLE)) if len(keys) else np.zeros(0, np.int64)
    keys, at = keys[whole], rows[whole]
    short = np.flatnonzero((own.counts > 0) & (own.counts < SHINGLE))
    if len(short):
        ends = own.offsets[short] + own.counts[short]
        place = np.arange(len(hashes)) - own.offsets[:-1][rows] if len(rows) else rows
        mixed = words.mix(hashes ^ words.mix(place.astype(_U)))
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mixed)])
        keys = np.concatenate([keys, words.mix(total[ends] - total[own.offsets[short]])])
        at = np.concatenate([at, short])
    order = np.lexsort((keys, at))
    keys, at = keys[order], at[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])
    keys, at = keys[new], at[new]
    return keys, np.searchsorted(at, np.arange(texts.rows + 1))


def _per_set(keys: np.ndarray, offsets: np.ndarray, reduce: np.ufunc) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, _U)
    filled = np.diff(offsets) > 0
    if filled.any():
        out[filled] = reduce.reduceat(keys, offsets[:-1][filled])
    return out


def set_names(keys: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits that name each set, whatever the order of its members."""
    parts = [_per_set(words.mix(keys ^ _U(seed)), offsets, np.add) for seed in (0x51ED, 0xC0FFEE)]
    return [bytes(x) for x in np.stack(parts, axis=1).astype("<u8").view(np.uint8).reshape(-1, 16)]


def band_hashes(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` hashes for each set; sets that agree on one band's MinHash values agree there."""
    out = np.zeros((len(offsets) - 1, BANDS), _U)
    for band in range(BANDS):
        mixed = np.full(len(offsets) - 1, band, _U)
        for row in range(ROWS):
            factor = words.mix(np.array([band * ROWS + row], _U))[0] | _U(1)
            mixed = words.mix(mixed ^ _per_set((keys ^ (keys >> _U(29))) * factor, offsets, np.minimum))
        out[:, band] = mixed
    return out


def signed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``d`` (id), ``t`` (name of the text), ``s`` (name of its shingle set), ``n`` shingles and band hashes."""
    rows = df.select(
        F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("t", F.unhex(F.md5(F.col("text").cast("binary"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in words.slices(batch.column("text")):
                keys, at = shingle_sets(texts)
                bands = band_hashes(keys, at).view(np.int64)
                own = [batch.column(c).slice(texts.first, texts.rows) for c in ("d", "t")]
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(set_names(keys, at), pa.binary()), pa.array(np.diff(at), pa.int64()), flat],
                    ["d", "t", "s", "n", "bands"],
                )

    return map_arrow(rows, run, "d long, t binary, s binary, n long, bands array<long>")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Each class (c) with the least class of every band bucket it shares.

    Spark takes an exploded row for a small part of its array's bytes, so a side that is
    ``BANDS`` rows a class would be broadcast by that size: it is merged instead.
    """
    rows = classes.select("c", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("c").alias("b"), F.count("*").alias("size")).filter("size > 1")
    return rows.hint("merge").join(buckets.select("band", "b"), "band").filter("c <> b").select(F.col("c").alias("a"), "b").distinct()


def blocks(groups: DataFrame) -> DataFrame:
    """Adds ``m``, the number of blocks of the class's group, and ``block``, the one that it is in."""
    sizes = groups.groupBy("g").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    m = F.greatest(F.ceil(F.col("k") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    joined = groups.join(sizes.select("g", m.alias("m")), "g")
    return joined.withColumn("block", F.pmod(F.xxhash64("c"), F.col("m")).cast("int"))


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``left`` shares with each of ``right``."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    keys = np.concatenate([*left, *right]) if left or right else np.zeros(0, _U)
    of = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
    is_left = np.arange(len(keys)) < sizes[0].sum()
    out = np.zeros((len(left), len(right)), np.int64)
    _, key, counts = np.unique(keys, return_inverse=True, return_counts=True)
    on_left, on_right = (np.bincount(key[side], minlength=len(counts)) for side in (is_left, ~is_left))
    both = (on_left > 0) & (on_right > 0)
    dense = np.flatnonzero(both & (counts >= DENSE_FROM))
    for low in range(0, len(dense), 2048):
        column = np.full(len(counts), -1)
        column[dense[low : low + 2048]] = np.arange(len(dense[low : low + 2048]))
        at = column[key]
        planes = []
        for side, n in ((is_left, len(left)), (~is_left, len(right))):
            plane = np.zeros((n, min(2048, len(dense) - low)), np.float32)
            chosen = side & (at >= 0)
            plane[of[chosen], at[chosen]] = 1
            planes.append(plane)
        out += np.rint(planes[0] @ planes[1].T).astype(np.int64)
    sparse = both & (counts < DENSE_FROM)
    chosen = [np.flatnonzero(side & sparse[key]) for side in (is_left, ~is_left)]
    chosen = [x[np.argsort(key[x], kind="stable")] for x in chosen]
    if len(chosen[0]):
        begins = np.searchsorted(key[chosen[1]], key[chosen[0]])
        times = on_right[key[chosen[0]]]
        for low in range(0, len(times), 1 << 16):
            part = times[low : low + (1 << 16)]
            place = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part - begins[low : low + (1 << 16)], part)
            pairs = np.repeat(of[chosen[0][low : low + (1 << 16)]], part) * len(right) + of[chosen[1][place]]
            out += np.bincount(pairs, minlength=out.size).reshape(out.shape)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets are similar enough, exactly."""
    shared = common(left, right)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return shared * (NUMERATOR + DENOMINATOR) >= NUMERATOR * total


def labels(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each node of a symmetric matrix reaches."""
    own = ids.copy()
    while True:
        seen = np.where(links, own[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(own, seen)
        if (new == own).all():
            return own
        own = new


VERIFIED = "c long, links long, label long"


def _verify(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    ids = table["c"].to_numpy()
    sizes = table["size"].to_numpy()
    side = table["side"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), _U) for x in table["shingles"]]
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one_block = table["i"][0].as_py() == table["j"][0].as_py()
    if one_block:
        second = first
    if not len(first) or not len(second):  # hashing may leave a block without a class
        return pa.table({name: pa.array([], pa.int64()) for name in ("c", "links", "label")})
    links = linked([sets[i] for i in first], [sets[i] for i in second])
    if one_block:
        np.fill_diagonal(links, False)
        found = links @ sizes
        label = labels(links, ids)
    else:
        found = np.zeros(len(ids), np.int64)
        found[first], found[second] = links @ sizes[second], links.T @ sizes[first]
        whole = np.zeros((len(ids), len(ids)), dtype=bool)
        whole[np.ix_(first, second)], whole[np.ix_(second, first)] = links, links.T
        label = labels(whole, ids)
    kept = found > 0
    return pa.table({"c": ids[kept], "links": found[kept], "label": label[kept]})


def verified(df: DataFrame, doc_id: str, text: str, grouped: DataFrame) -> DataFrame:
    """Links of the classes in ``grouped`` (c, t, copy_of, size, g, m, block), on the shingles of their texts in ``df``.

    Rows meet by id and text, so that copies of a frequent text go to many tasks and
    only the one that stands for its class stays.
    """
    key = ["t", "own", "no_id"]
    own = lambda d: [F.coalesce(d, F.lit(0).cast("long")).alias("own"), d.isNull().alias("no_id")]
    texts = df.select(*own(F.col(doc_id).cast("long")), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("t", F.unhex(F.md5(F.col("text").cast("binary"))))
    wanted = grouped.select("t", *own(F.col("copy_of")), "c", "size", "g", "m", "block")
    rows = texts.join(wanted, key).dropDuplicates(key).drop(*key)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch.column("text")):
                keys, at = shingle_sets(part)
                content, limits = keys.tobytes(), (at * 8).tolist()
                sets = [content[a:b] for a, b in zip(limits, limits[1:], strict=False)]
                own = [batch.column(c).slice(part.first, part.rows) for c in ("c", "size", "g", "m", "block")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sets, pa.binary())], ["c", "size", "g", "m", "block", "shingles"])

    sets = map_arrow(rows, shingled, "c long, size long, g long, m int, block int, shingles binary")
    # Block b meets every block once: as the first of (b, j) for j >= b, as the second of (i, b) for i < b.
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    pairs = sets.withColumn("other", other).select(
        "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "c", "size", "shingles",
    )
    return pairs.groupBy("g", "i", "j").applyInArrow(_verify, VERIFIED)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``class_id``, ``copy_of``, ``n_links``, ``t`` (MD5 of its text) and ``component``.

    ``class_id`` is the least id of the texts that links connect, ``copy_of`` the
    least id with the same set of shingles, ``n_links`` the number of other rows
    whose shingles have a Jaccard similarity of 0.8 or more with the row's, copies
    included.  ``component`` is a number for ``class_id`` that repeated ids cannot
    confuse.  A null or empty text, or one of blanks only, has no shingles, is linked
    to nothing and has no component.  An empty table gives an empty one.  Repeated rows are copies of each other.  A null id is never
    the least one, unless there is no other.  Other columns are left out.
    """
    rows = written(signed(df, doc_id, text), "signed")
    least = F.min(F.struct(F.col("d").isNull(), "d", "t"))
    classes = rows.filter("n > 0").groupBy("s").agg(
        least.alias("least"), F.first("n").alias("n"), F.count("*").alias("size"), F.first("bands").alias("bands"),
    ).select("s", "least.t", "n", "size", "bands", F.col("least.d").alias("copy_of"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    grouping = components(candidate_edges(classes))
    roots = grouping.select(F.col("root").alias("c"), F.col("root").alias("g")).distinct()
    groups = grouping.select(F.col("node").alias("c"), F.col("root").alias("g")).unionByName(roots)
    grouped = blocks(groups.join(classes.select("c", "t", "copy_of", "n", "size"), "c"))
    found = written(verified(df, doc_id, text, grouped), "links")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    final = components(found.select(F.col("c").alias("a"), F.col("label").alias("b")))
    named = (
        classes.select("s", "c", "size", "copy_of").join(links, "c", "left")
        .join(final.withColumnRenamed("node", "c"), "c", "left")
        .withColumn("root", F.coalesce("root", "c"))
    )
    least = named.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    named = named.join(least, "root").select(
        F.col("s").alias("of"), F.col("root").alias("component"), "class_id", "copy_of", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    joined = rows.select("d", "t", "n", "s").join(named, (F.col("s") == F.col("of")) & (F.col("n") > 0), "left")
    return joined.select(
        F.col("d").alias("doc_id"), F.coalesce("class_id", "d").alias("class_id"),
        F.coalesce("copy_of", "d").alias("copy_of"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "t", "component",
    )


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of near-duplicates, that of the least id (of the least text hash, on ties).

    Rows without shingles all stay.
    """
    found = near_duplicates(df, doc_id, text)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "t")
    least = found.filter("component is not null").groupBy("component").agg(F.min(order).alias("m"))
    kept = least.select(F.col("m.t").alias("kept_t"), F.col("m.doc_id").alias("kept_d"), F.lit(True).alias("one"))
    bare = found.filter("component is null").select(
        F.col("t").alias("kept_t"), F.col("doc_id").alias("kept_d"), F.lit(False).alias("one")
    )
    name = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(doc_id).cast("long").alias("own_d"), name.alias("own_t"))
    joined = rows.join(
        kept.unionByName(bare).distinct(), (F.col("own_t") == F.col("kept_t")) & F.col("own_d").eqNullSafe(F.col("kept_d"))
    )
    single = joined.filter("one").dropDuplicates(["own_t"]).select("row")
    return single.unionByName(joined.filter("not one").select("row")).select("row.*")
