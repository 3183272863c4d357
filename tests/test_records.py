"""Files with line breaks in fields, read by many tasks: the same rows as one task reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from lupafiscal.sources import ptbr_csv
from lupafiscal.sources.records import records

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())])
BLOCK = "spark.sql.files.maxPartitionBytes"
# Small files share a task unless opening one costs as much as a block.
OPEN = "spark.sql.files.openCostInBytes"


def by_one_task(spark, path):
    rows = spark.read.csv(
        path, schema="a string, b string, n string", sep=";", header=True, quote='"', escape='"', mode="FAILFAST",
        nullValue=ptbr_csv.NO_TEXT, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, multiLine=True,
    )
    return sorted((r.a, r.b, int(r.n)) for r in rows.collect())


def rows_of(seed: int, n: int) -> list[tuple[str, str, int]]:
    """Fields of letters, separators, doubled quotes and line breaks; some of breaks alone, some long."""
    draw = random.Random(seed)
    signs = ["x", "é", ";", '"', "\n", "\n\n", "\r\n", " "]
    field = lambda: "".join(draw.choice(signs) for _ in range(draw.choice([1, 3, 8, 60])))
    return [(field(), field(), i) for i in range(n)]


def as_csv(rows, end="\n") -> str:
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    return end.join(["a;b;n", *(f"{quoted(a)};{quoted(b)};{n}" for a, b, n in rows)]) + end


def put(path, text: str) -> str:
    path.write_bytes(text.encode())
    return str(path)


def found(spark, path):
    return sorted(map(tuple, ptbr_csv.read(spark, path, SCHEMA, line_breaks=True).collect()))


@pytest.mark.parametrize("size", [7, 40, 333, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_do_not_depend_on_the_blocks(spark, tmp_path, settings, size, end):
    rows = rows_of(size, 12 if size == 7 else 40)
    path = put(tmp_path / "in.csv", as_csv(rows, end))
    expected = by_one_task(spark, path)
    settings({BLOCK: str(size), OPEN: str(size)})
    assert found(spark, path) == sorted(rows)
    # The one-task reader takes the file's line end within quotes for a line feed.
    assert expected == sorted((a.replace(end, "\n"), b.replace(end, "\n"), n) for a, b, n in rows)


def test_a_break_at_every_border(spark, tmp_path, settings):
    """One record with breaks at each byte of a block's border, in turn."""
    for shift in range(6):
        rows = [("s" * shift + "\n" * 30, 'q"' * 9 + "\nend", 0), ("", "\n", 1), ("last", "\n;\n", 2)]
        path = put(tmp_path / f"{shift}.csv", as_csv(rows))
        settings({BLOCK: "6", OPEN: "6"})
        assert found(spark, path) == sorted(rows)


def test_several_tasks_read_one_file(spark, tmp_path, settings):
    path = put(tmp_path / "in.csv", as_csv(rows_of(1, 200)))
    settings({BLOCK: "512", OPEN: "512"})
    assert ptbr_csv.read_text(spark, path, SCHEMA, line_breaks=True).count() == 200
    blocks = records(spark, path).select("arquivo", "bloco").distinct().count()
    assert blocks > 10


def test_several_files_without_last_line_end(spark, tmp_path):
    (tmp_path / "d").mkdir()
    parts = [rows_of(s, 15) for s in (2, 3)]
    for i, rows in enumerate(parts):
        put(tmp_path / "d" / f"{i}.csv", ("﻿" if i == 0 else "") + as_csv(rows).rstrip("\n"))
    assert found(spark, str(tmp_path / "d")) == sorted(parts[0] + parts[1])


def test_null_and_empty_text_and_empty_lines(spark, tmp_path):
    path = put(tmp_path / "in.csv", 'a;b;n\n;"";1\n\n"\n";" x ";2\n')
    rows = {r.n: (r.a, r.b) for r in ptbr_csv.read(spark, path, SCHEMA, line_breaks=True).collect()}
    assert rows == {1: (None, ""), 2: ("\n", " x ")}


def test_a_header_alone_has_no_rows(spark, tmp_path):
    assert found(spark, put(tmp_path / "in.csv", "a;b;n\n")) == []


def test_bad_files_raise(spark, tmp_path, settings):
    for name, text, message in [
        ("open", 'a;b;n\n"x;y;1\nz;w;2\n', "within quotes"),
        ("fields", 'a;b;n\n"x\n";y;1;4\n', "(?i)malformed"),
    ]:
        path = put(tmp_path / f"{name}.csv", text)
        for size in ("5", "1000"):
            settings({BLOCK: size, OPEN: size})
            with pytest.raises(Exception, match=message):
                found(spark, path)
    (tmp_path / "d").mkdir()
    put(tmp_path / "d" / "a.csv", "a;b;n\nx;y;1\n")
    put(tmp_path / "d" / "b.csv", "b;a;n\nx;y;1\n")
    with pytest.raises(Exception, match="another header"):
        found(spark, str(tmp_path / "d"))
