"""CSV in the Brazilian format, Parquet, JDBC settings and the stored fact."""

from __future__ import annotations

import glob
import subprocess
import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lupafiscal import CHECKS, run, session
from lupafiscal.functions.money import from_ptbr, is_bad_money, to_ptbr
from lupafiscal.operators import exchange
from lupafiscal.plans import store
from lupafiscal.schemas import SCHEMAS
from lupafiscal.sources import jdbc, parquet, ptbr_csv
from tests import tables

SCHEMA = T.StructType([
    T.StructField("nome", T.StringType()),
    T.StructField("cnpj", T.StringType()),
    T.StructField("valor", T.DecimalType(15, 2)),
    T.StructField("data", T.DateType()),
    T.StructField("n", T.IntegerType()),
])
ROWS = [
    ("João; Cia", "00000070000170", Decimal("1024.70"), date(2024, 1, 7), 7),
    ('Ana "A"', "000001200001120", Decimal("1434135.30"), date(2023, 12, 31), None),
    ("Zé", "1", Decimal("500.00"), None, 0),
    ("Negativo", "2", Decimal("-0.05"), date(2024, 2, 29), -3),
    ("Vazio", None, None, None, None),
]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, SCHEMA)
    ptbr_csv.write(df, path)
    back = ptbr_csv.read(spark, path, SCHEMA)
    assert back.schema == SCHEMA or [f.dataType for f in back.schema] == [f.dataType for f in SCHEMA]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(ROWS, key=str)


HARD = [
    ("  blanks around  ", "", Decimal("1.00"), None, 1),
    ("", None, Decimal("2.00"), None, 2),
    (None, " ", None, None, 3),
    ("a;b", 'q"u""o', Decimal("3.10"), None, 4),
    ("\\", "\\\\;", Decimal("4.00"), None, 5),
    ('"', "''", Decimal("5.00"), None, 6),
]


def test_texts_come_back_as_they_went(spark, tmp_path):
    path = str(tmp_path / "out")
    ptbr_csv.write(spark.createDataFrame(HARD, SCHEMA), path)
    assert sorted(map(tuple, ptbr_csv.read(spark, path, SCHEMA).collect()), key=str) == sorted(HARD, key=str)


def test_line_breaks_are_refused_or_kept(spark, tmp_path):
    rows = [("two\nlines", "cr\rhere", Decimal("1.00"), None, 1), ("plain", None, None, None, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(Exception, match="line break in nome"):
        ptbr_csv.write(df, str(tmp_path / "refused"))
    ptbr_csv.write(df, str(tmp_path / "kept"), line_breaks=True)
    back = ptbr_csv.read(spark, str(tmp_path / "kept"), SCHEMA, line_breaks=True).collect()
    assert {r["n"]: r["nome"] for r in back} == {1: "two\nlines", 2: "plain"}


def test_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "in.csv").write_text("n;valor;nome;extra;cnpj;data\n7;1,5;João;x;007;2024-01-07\n", "utf-8-sig")
    rows = ptbr_csv.read(spark, str(tmp_path / "in.csv"), SCHEMA).collect()
    assert rows == [("João", "007", Decimal("1.50"), date(2024, 1, 7), 7)]
    (tmp_path / "short.csv").write_text("nome;valor\nJoão;1,5\n")
    with pytest.raises(ValueError, match="cnpj"):
        ptbr_csv.read(spark, str(tmp_path / "short.csv"), SCHEMA)


def test_files_with_different_headers_raise(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("nome;cnpj;valor;data;n\na;1;1,0;;1\n")
    (tmp_path / "d" / "b.csv").write_text("cnpj;nome;valor;data;n\n1;a;1,0;;1\n")
    with pytest.raises(Exception):
        ptbr_csv.read(spark, str(tmp_path / "d"), SCHEMA).collect()


def test_report_is_written_once_where_the_caller_says(spark, tmp_path):
    source = tables.audit(spark, tables.hand_made())
    with pytest.raises(ValueError, match="write the report first"):
        run("m02_csv_sink", source)
    path = str(tmp_path / "report")
    written = exchange.write_report(source, path)
    files = sorted(glob.glob(f"{path}/*"))
    back = run("m03_csv_source", written)
    assert tables.rows_of(back) == tables.rows_of(run("m01_irregularity_report", source))
    assert run("m02_csv_sink", written).count() == back.count()
    assert sorted(glob.glob(f"{path}/*")) == files
    assert back.schema == exchange.REPORT


def test_delivered_amounts_that_do_not_fit_are_reported(spark, tmp_path):
    source = tables.audit(spark, tables.random_tables(3, 10))
    root = str(tmp_path / "tables")
    parquet.write_tables(source, root)
    wide = spark.createDataFrame([(1, Decimal("12345678901234567.00")), (2, Decimal("5.00"))], "id_contrato long, valor decimal(20,2)")
    contracts = source.table("contrato").drop("valor", "id_contrato").limit(1)
    contracts.crossJoin(wide).write.mode("overwrite").parquet(f"{root}/contrato")
    found = {(r["tabela"], r["coluna"]): r["violacoes"] for r in run("d05_domain_violations", parquet.open_audit(spark, root)).collect()}
    assert found["contrato", "valor"] == 1 and found["pagamento", "valor"] == 0

    csv_root = tmp_path / "csv"
    for name in SCHEMAS:
        ptbr_csv.write(source.table(name), str(csv_root / name))
    (csv_root / "pagamento" / "more.csv").write_text(
        "id_pagamento;id_empenho;datapagamentoemp;valor\nP1;E1;2024-01-01;99999999999999,99\nP2;E1;2024-01-01;x\nP3;E1;2024-01-01;1.000,5\n",
        "utf-8-sig")
    csv = ptbr_csv.open_audit(spark, str(csv_root))
    found = {(r["tabela"], r["coluna"]): r["violacoes"] for r in run("d05_domain_violations", csv).collect()}
    assert found["pagamento", "valor"] == 2 and found["contrato", "valor"] == 0
    assert tables.rows_of(csv.table("nfe")) == tables.rows_of(source.table("nfe"))


def test_written_form(spark, tmp_path):
    path = str(tmp_path / "out")
    ptbr_csv.write(spark.createDataFrame(ROWS[:3], SCHEMA).coalesce(1), path)
    part, = glob.glob(f"{path}/*.csv")
    raw = open(part, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfnome;cnpj;valor;data;n\n")
    lines = raw.decode("utf-8-sig").splitlines()
    assert lines[1] == '"João; Cia";00000070000170;1024,7;2024-01-07;7'
    assert ";1434135,3;2023-12-31;" in lines[2]
    assert lines[3] == "Zé;1;500,0;;0"


def test_no_mark_on_request(spark, tmp_path):
    path = str(tmp_path / "out")
    ptbr_csv.write(spark.createDataFrame(ROWS, SCHEMA), path, bom=False)
    for part in glob.glob(f"{path}/*.csv"):
        assert open(part, "rb").read(4) == b"nome"


def test_local_dates_and_thousand_points(spark, tmp_path):
    (tmp_path / "in.csv").write_text("nome;cnpj;valor;data;n\nJoão;007;1.434.135,3;07/01/2024;7\n", "utf-8-sig")
    df = ptbr_csv.read(spark, str(tmp_path / "in.csv"), SCHEMA, ptbr_csv.LOCAL_DATE)
    assert df.collect() == [("João", "007", Decimal("1434135.30"), date(2024, 1, 7), 7)]


def test_amount_text(spark):
    amounts = [Decimal(n) / 100 for n in (0, 1, 10, 99, 100, 110, 123456789, -5, -1000)]
    df = spark.createDataFrame([(a,) for a in amounts], "a decimal(15,2)")
    df = df.withColumn("t", to_ptbr("a")).withColumn("back", from_ptbr("t"))
    for a, text, back in df.collect():
        assert back == a
        assert text == str(float(a)).replace(".", ",")


def test_bad_amounts_are_found_and_not_swallowed(spark, tmp_path):
    texts = ["1,5", "x", "99999999999999,99", None, "1.000,00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(is_bad_money("t")).collect()] == [False, True, True, False, False]
    with pytest.raises(Exception):
        df.select(from_ptbr("t")).collect()
    (tmp_path / "in.csv").write_text("nome;cnpj;valor;data;n\na;1;x;;\nb;1;2,0;;\n")
    bad = ptbr_csv.bad_amounts(spark, str(tmp_path / "in.csv"), SCHEMA)
    assert [r["nome"] for r in bad.collect()] == ["a"]


def test_parquet_round_trip(spark, tmp_path):
    root = str(tmp_path / "tables")
    source = tables.audit(spark, tables.random_tables(3, 40))
    parquet.write_tables(source, root)
    back = parquet.open_audit(spark, root)
    for name, schema in SCHEMAS.items():
        columns = schema.names
        assert tables.rows_of(back.table(name, *columns)) == tables.rows_of(source.table(name, *columns))


def test_parquet_with_narrow_ids(spark, tmp_path):
    """Files written with 32-bit ids are read as 64-bit ones."""
    root = str(tmp_path / "tables")
    df = spark.createDataFrame([(7, "Alfa", "007")], "id_fornecedor int, nome string, documento string")
    df.write.parquet(f"{root}/fornecedor")
    rows = parquet.open_audit(spark, root).table("fornecedor", "id_fornecedor", "documento")
    assert rows.schema["id_fornecedor"].dataType == T.LongType()
    assert rows.collect() == [(7, "007")]


@pytest.mark.parametrize("size", [0, 10**9, 10**12, 10**14])
def test_sized_settings(size):
    sized = session.sized_for(size)
    partitions = int(sized["spark.sql.shuffle.partitions"])
    assert 8 <= partitions <= 10**5
    assert size / partitions <= 2 << 30
    assert sized["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == str(partitions)
    assert size / int(sized["spark.sql.files.maxPartitionBytes"]) <= 10**5


def test_a_session_is_sized_for_what_is_stored(spark, tmp_path, settings):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    assert session.stored_bytes(spark, str(tmp_path / "t")) > 1000
    settings({key: value for key, value in session.sized_for(1 << 40).items()})
    session.fit(spark, 1 << 40)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8192"


# Checks that must start from the stored fact; the others do not look at payments with their commitments.
ON_THE_FACT = (
    "c02 c13 c15 g01 g02 g04 g04b g05 g06 g07 g09 g10 g12 g13 g14 g15 m01 m04 q04 q05 q08 q11 q12 q13 q14 q15 q20 "
    "q24 q25 q26 q29 q32 q33 q34 r02 s01"
).split()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    plain = tables.audit(spark, tables.random_tables(11, 50))
    path = str(tmp_path_factory.mktemp("fact") / "fact")
    store.write_payment_fact(plain, path)
    return plain, store.with_stored_fact(plain, path), path


@pytest.mark.parametrize("key", ON_THE_FACT)
def test_stored_fact_gives_the_same_rows(stored, key):
    plain, fast, path = stored
    (name,) = [n for n in CHECKS if n.split("_")[0] == key]
    df = run(name, fast)
    assert any(path in file for file in df.inputFiles())
    assert tables.rows_of(df) == tables.rows_of(run(name, plain))


# Checks that must take sums per commitment from the stored fact.
ON_THE_COMMITMENT_FACT = "g03 g03b g08 g11 q02 q03 q17 q18 q19 q21 q22 q30 q30b s01".split()


@pytest.fixture(scope="module")
def stored_sums(spark, tmp_path_factory):
    plain = tables.audit(spark, tables.random_tables(12, 50))
    root = str(tmp_path_factory.mktemp("facts") / "facts")
    store.write_facts(plain, root)
    return plain, root


@pytest.mark.parametrize("key", ON_THE_COMMITMENT_FACT)
def test_commitment_fact_gives_the_same_rows(stored_sums, key):
    plain, root = stored_sums
    (name,) = [n for n in CHECKS if n.split("_")[0] == key]
    for fast in (store.with_stored_commitments(plain, f"{root}/commitments"), store.with_stored_facts(plain, root)):
        df = run(name, fast)
        assert any(f"{root}/commitments" in file for file in df.inputFiles())
        assert tables.rows_of(df) == tables.rows_of(run(name, plain))


def test_stored_fact_needs_no_join(stored, settings):
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    _, fast, _ = stored
    text = run("q24_payment_over_ceiling_summary", fast)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text


def test_jdbc_slices():
    slices = jdbc.Slices("datapagamentoemp", "2020-01-01", "2024-12-31", 64)
    options = jdbc.read_options("pagamento", "jdbc:x", slices)
    assert options["partitionColumn"] == "datapagamentoemp"
    bounds = (options["lowerBound"], options["upperBound"], options["numPartitions"])
    assert bounds == ("2020-01-01", "2024-12-31", "64")
    assert "partitionColumn" not in jdbc.read_options("entidade", "jdbc:x", None)
    for table, column in jdbc.SLICE_COLUMNS.items():
        assert not isinstance(SCHEMAS[table][column].dataType, T.StringType)
    assert "MIN(id_contrato)" in jdbc.bounds_query("contrato")


def test_jdbc_predicates(spark):
    with pytest.raises(ValueError, match="pagamento"):
        jdbc.open_audit(spark, "jdbc:x", {}, {"pagamento": jdbc.Slices("a", "1", "2", 2)}, {"pagamento": ["a = 1"]})


class Session:
    """Only what the folder is looked up from."""

    def __init__(self, master: str, folder: str | None):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_is_the_clusters():
    folder = session.new_run_folder(Session("yarn", "/shared/scratch/"), "x")
    assert folder.startswith("/shared/scratch/x-")
    with pytest.raises(ValueError):
        session.shared_folder(Session("yarn", None))
    assert session.shared_folder(Session("local[2]", None))


def test_entry_lists_every_check():
    import __spark_entry__ as entry

    assert set(CHECKS) <= set(entry.queries())
    assert set(CHECKS) <= set(entry.oracle_sql()) <= set(entry.queries())


WITHOUT_LLM = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lupafiscal.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
from lupafiscal import CHECKS
assert set(entry.queries()) == set(entry.oracle_sql()) == set(CHECKS)
"""


def test_entry_works_without_the_training_text_operators():
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", WITHOUT_LLM], cwd=root, check=True, timeout=120)


def test_widths_of_totals(spark):
    """A total past 10^16 is kept whole."""
    df = spark.range(3).select(F.lit("9999999999999.99").cast("decimal(15,2)").alias("v"))
    from lupafiscal.functions.money import total
    assert df.agg(total("v").alias("t")).first()["t"] == Decimal("29999999999999.97")


def test_command(spark, tmp_path):
    from lupafiscal.__main__ import main

    source = tables.audit(spark, tables.hand_made())
    root, out, fact = (str(tmp_path / n) for n in ("tables", "out", "fact"))
    parquet.write_tables(source, root)
    name = "q24_payment_over_ceiling_summary"
    kept = {key: spark.conf.get(key, None) for key in session.sized_for(0)}
    main(["--tables", root, "--out", out, "--new-fact", fact, name])
    expected = run(name, source)
    assert tables.rows_of(ptbr_csv.read(spark, f"{out}/{name}", expected.schema)) == tables.rows_of(expected)
    main(["--tables", root, "--out", f"{out}2", "--fact", fact, "--format", "parquet", name])
    assert tables.rows_of(spark.read.parquet(f"{out}2/{name}")) == tables.rows_of(expected)
    for table in SCHEMAS:
        ptbr_csv.write(source.table(table), f"{root}-csv/{table}")
    main(["--csv-tables", f"{root}-csv", "--out", f"{out}3", "--format", "parquet", name])
    assert tables.rows_of(spark.read.parquet(f"{out}3/{name}")) == tables.rows_of(expected)
    for key, value in kept.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    with pytest.raises(SystemExit):
        main(["--tables", root, "--out", out, "no_such_check"])
    with pytest.raises(SystemExit):
        main(["--out", out, name])
