"""Bad lines beside good rows, and datasets whose files are checked."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest

from lupafiscal import run
from lupafiscal.operators import exchange
from lupafiscal.schemas import SCHEMAS
from lupafiscal.sources import ptbr_csv
from tests import tables

SCHEMA = SCHEMAS["pagamento"]
HEADER = "id_pagamento;id_empenho;datapagamentoemp;valor"
GOOD = ["P1;E1;2024-01-05;1.024,70", '"P;2";E1;2024-01-06;3', 'P3;"say ""hi""";;', '"";E2;2024-02-01;0,5']
BAD = {
    "P4;E1;2024-01-05": "CAMPOS", "P5;E1;2024-01-05;1;2": "CAMPOS", '"P6;E1;2024-01-05;1': "ASPAS",
    "P7;E1;2024-13-05;1": "VALOR: datapagamentoemp", "P8;E1;2024-01-05;12a": "VALOR: valor",
    "P9;E1;2024-01-05;99999999999999": "VALOR: valor",
}


def written(folder: Path, files: dict[str, list[str]], end: str = "\n") -> str:
    folder.mkdir()
    for name, lines in files.items():
        (folder / name).write_text(end.join([HEADER, *lines]) + end, encoding="utf-8")
    return str(folder)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_line_is_a_row_or_kept_apart(spark, tmp_path, end):
    lines = [GOOD[0], *BAD, "", *GOOD[1:]]
    path = written(tmp_path / "t", {"a.csv": lines, "b.csv": GOOD, "c.csv": list(BAD)}, end)
    good, bad = ptbr_csv.read_apart(spark, path, SCHEMA)
    clean = written(tmp_path / "clean", {"a.csv": GOOD + GOOD}, end)
    assert tables.rows_of(good) == tables.rows_of(ptbr_csv.read(spark, clean, SCHEMA))
    kept = bad.collect()
    assert sorted((r.texto, r.motivo) for r in kept) == sorted([*BAD.items(), *BAD.items()])
    assert good.count() + len(kept) == 2 * (len(GOOD) + len(BAD))
    # The place is that of the line in its file.
    for r in kept:
        text = (tmp_path / "t" / r.arquivo.rsplit("/", 1)[1]).read_bytes()[r.bloco :].decode().split(end)
        assert text[r.linha] == r.texto


def test_places_in_files_read_by_several_tasks(spark, tmp_path, settings):
    lines = [f"P{i};E{i};2024-01-05;{i}" if i % 7 else f"P{i};E{i}" for i in range(5000)]
    path = written(tmp_path / "t", {"a.csv": lines})
    settings({"spark.sql.files.maxPartitionBytes": "16KB", "spark.sql.files.openCostInBytes": "1"})
    good, bad = ptbr_csv.read_apart(spark, path, SCHEMA)
    kept = bad.collect()
    assert len({r.bloco for r in kept}) > 3
    assert good.count() == sum(i % 7 > 0 for i in range(5000)) and len(kept) == 5000 - good.count()


def test_another_header_raises(spark, tmp_path):
    path = written(tmp_path / "t", {"a.csv": GOOD})
    (tmp_path / "t" / "b.csv").write_text("id_empenho;id_pagamento;datapagamentoemp;valor\nE1;P1;;\n")
    with pytest.raises(Exception, match="another header"):
        ptbr_csv.read_apart(spark, path, SCHEMA)[0].collect()


def test_tables_load_without_their_bad_lines(spark, tmp_path):
    case = tables.hand_made()
    audit = tables.audit(spark, case)
    for name, schema in SCHEMAS.items():
        ptbr_csv.write(audit.table(name, *schema.names), f"{tmp_path}/csv/{name}")
    part = next((tmp_path / "csv" / "pagamento").glob("part-*.csv"))
    part.write_text(part.read_text(encoding="utf-8") + "P99;E1\n", encoding="utf-8")
    (tmp_path / "csv" / "pagamento" / f".{part.name}.crc").unlink(missing_ok=True)
    ptbr_csv.write_quarantine(spark, f"{tmp_path}/csv", f"{tmp_path}/bad")
    (row,) = spark.read.parquet(f"{tmp_path}/bad/pagamento").collect()
    assert (row.texto, row.motivo) == ("P99;E1", "CAMPOS")
    kept = ptbr_csv.open_audit(spark, f"{tmp_path}/csv", leave_bad_lines=True)
    con = tables.database(case)
    for name in ("q24_payment_over_ceiling_summary", "m05_source_scan"):
        assert tables.rows_of(run(name, kept)) == tables.rows_of_sql(con, name)


def test_lost_copied_and_changed_parts_are_found(spark, tmp_path):
    audit = exchange.write_report(tables.audit(spark, tables.random_tables(5, 60)), f"{tmp_path}/report")
    assert run("m03_csv_source", audit).count()
    parts = sorted((tmp_path / "report").glob("part-*.csv"))
    kept = parts[0].read_bytes()
    copy = parts[0].with_name("part-99999-copy.csv")
    shutil.copy(parts[0], copy)
    with pytest.raises(ValueError, match="part-99999-copy.csv not listed"):
        run("m03_csv_source", audit)
    copy.unlink()
    checksum = parts[0].with_name(f".{parts[0].name}.crc")
    checksum.unlink(missing_ok=True)
    lines = kept.splitlines(keepends=True)
    parts[0].write_bytes(b"".join([*lines[:-1], lines[-1][1:]]))
    with pytest.raises(ValueError, match="changed"):
        run("m03_csv_source", audit)
    parts[0].unlink()
    with pytest.raises(ValueError, match="missing"):
        run("m03_csv_source", audit)
    parts[0].write_bytes(kept)
    assert run("m03_csv_source", audit).count()
