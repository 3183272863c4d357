from __future__ import annotations

import zlib

import numpy as np
import pytest

from lupafiscal.llm import bpe, token_files
from lupafiscal.session import new_run_folder
from tests.llm import cases


def written(spark, rows, per_file=3, file_bytes=token_files.FILE_BYTES):
    folder = new_run_folder(spark, "tokens")
    token_files.write(cases.documents(spark, rows), folder, cases.PATH, 2, records_per_file=per_file, file_bytes=file_bytes)
    return folder, token_files.write_index(spark, folder, new_run_folder(spark, "index"), cases.PATH, 2)


ROWS = [*enumerate(cases.odd_texts()), (77, "seventy seven"), (-5, "minus"), (20, cases.prose(1, 20_000)), (13, "again"), (13, "again")]


def test_round_trip(spark):
    _, index = written(spark, ROWS)
    found = token_files.with_starts(index).orderBy("start", "n_tokens").collect()
    library = bpe.library(cases.PATH)
    ids = {}
    for d, text in ROWS:
        ids.setdefault(d, []).append([*library.encode(text or "", add_special_tokens=False).ids, 2])
    assert [r.doc_id for r in found] == sorted(d for d, _ in ROWS)
    start = 0
    for row in found:
        own = next(x for x in ids[row.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == row.ids_crc32)
        assert (row.start, row.n_tokens) == (start, len(own))
        start += len(own)


def test_null_id_comes_first(spark):
    _, index = written(spark, [(3, "three"), (None, "none"), (None, None), (1, "one")], per_file=1)
    found = token_files.with_starts(index).orderBy("start", "n_tokens").collect()
    assert [r.doc_id for r in found] == [None, None, 1, 3]


def test_records_are_read_by_their_places(spark):
    _, index = written(spark, ROWS)
    some = index.filter("doc_id in (77, 4)")
    got = {r.doc_id: r.ids for r in token_files.read_records(spark, some, cases.PATH, 2).collect()}
    library = bpe.library(cases.PATH)
    texts = dict(ROWS)
    assert got == {d: [*library.encode(texts[d], add_special_tokens=False).ids, 2] for d in (77, 4)}


def test_files_are_bounded_by_bytes(spark):
    rows = [(i, cases.prose(i, 50 + 40 * (i % 7))) for i in range(120)] + [(500, cases.prose(9, 20_000))]
    _, index = written(spark, rows, per_file=1000, file_bytes=2000)
    sizes = {}
    for r in index.collect():
        sizes.setdefault(r.path, []).append(r.length)
    assert all(sum(own) <= 2000 or len(own) == 1 for own in sizes.values())
    assert any(len(own) > 1 for own in sizes.values())
    found = token_files.with_starts(index).orderBy("start").collect()
    assert [r.doc_id for r in found] == [d for d, _ in rows]
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]


def test_a_repeated_row_is_written_by_several_tasks(spark):
    rows = [(5, "the same row")] * 4000 + [(i, f"row {i}") for i in range(10)]
    joining = "spark.sql.adaptive.coalescePartitions.enabled"  # of partitions as small as these
    spark.conf.set(joining, "false")
    try:
        _, index = written(spark, rows, per_file=100_000)
    finally:
        spark.conf.unset(joining)
    tasks = {r.path.rpartition("/")[2].split("-")[1] for r in index.filter("doc_id = 5").select("path").collect()}
    assert len(tasks) > 1
    found = token_files.with_starts(index).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(d for d, _ in rows)


def test_damage_is_noticed():
    content = token_files.frame(5, b"\x01\x00\x02\x00") + token_files.TERMINATOR
    assert [(o, d, bytes(p)) for o, _, d, p in token_files.records(content)] == [(0, 5, b"\x01\x00\x02\x00")]
    for at in range(len(content)):
        damaged = bytearray(content)
        damaged[at] ^= 4
        with pytest.raises(ValueError):
            list(token_files.records(bytes(damaged)))


def test_empty_table(spark):
    _, index = written(spark, [])
    assert token_files.with_starts(index).count() == 0
    assert token_files.read_records(spark, index, cases.PATH, 2).count() == 0
