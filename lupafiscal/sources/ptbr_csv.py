"""Brazilian-format CSV: ``;`` between fields, decimal comma, UTF-8.

Reading and writing are distributed: a dataset is a folder of part files, each
with its header line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lupafiscal.audit import Audit
from lupafiscal.functions.money import from_ptbr, is_bad_money, to_ptbr, try_ptbr
from lupafiscal.schemas import SCHEMAS
from lupafiscal.sources.records import records

BOM = "\ufeff"
ISO_DATE = "yyyy-MM-dd"
LOCAL_DATE = "dd/MM/yyyy"


# Fixed value: a text that no field holds.  Without it an empty text would be read as null.
NO_TEXT = "\x00null\x00"


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first file as written, with a byte order mark if there is one."""
    sample = spark.read.csv(path, sep=";", header=True, encoding="UTF-8", quote='"', escape='"', inferSchema=False)
    return sample.columns


def read_text(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = False) -> DataFrame:
    """The fields as written, bound by the names in the header; blanks are kept and an empty
    text (``""``) is not null.

    Files may have the columns in any one order and a byte order mark; a file whose header
    differs from the first one's, or that lacks a column, raises.  ``line_breaks``: fields
    may hold some; a file is still read by many tasks, at the price of a shuffle by block.
    """
    written = _header(spark, path)
    plain = {name.removeprefix(BOM): name for name in written}
    missing = [f.name for f in schema if f.name not in plain]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    text = T.StructType([T.StructField(name, T.StringType()) for name in written])
    if line_breaks:
        return _records_as_rows(records(spark, path), text).select(
            [F.col("fields").getField(plain[f.name]).alias(f.name) for f in schema])
    rows = spark.read.csv(
        path, schema=text, sep=";", header=True, encoding="UTF-8", quote='"', escape='"', mode="FAILFAST",
        enforceSchema=False, nullValue=NO_TEXT, emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return rows.select([F.col(f"`{plain[f.name]}`").alias(f.name) for f in schema])


def _records_as_rows(found: DataFrame, text: T.StructType) -> DataFrame:
    """``fields`` of each record but the headers; one that doesn't fit the header raises."""
    options = SEPARATED | {"mode": "FAILFAST", "multiLine": "true"}
    is_header = _is_header((F.col("bloco") == 0) & (F.col("r") == 1), text.names)
    return found.filter(~is_header).select(F.from_csv("texto", _ddl(text), options).alias("fields"))


def read(spark: SparkSession, path: str, schema: T.StructType, date_format: str = ISO_DATE,
         line_breaks: bool = False) -> DataFrame:
    """Typed columns; a number or date that cannot be read raises."""
    def typed(field: T.StructField):
        text = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return from_ptbr(text, field.dataType.simpleString()).alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.to_date(text, date_format).alias(field.name)
        return text.cast(field.dataType).alias(field.name)

    return read_text(spark, path, schema, line_breaks).select([typed(f) for f in schema])


def bad_amounts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows with an amount that is no number or does not fit its decimal type."""
    bad = F.lit(False)
    for field in schema:
        if isinstance(field.dataType, T.DecimalType):
            bad = bad | is_bad_money(field.name, field.dataType.simpleString())
    return read_text(spark, path, schema).filter(bad)


def write(df: DataFrame, path: str, bom: bool = True, mode: str = "errorifexists",
          line_breaks: bool = False) -> None:
    """Amounts with decimal comma; texts exactly as they are, an empty one as ``""``, null as nothing.

    ``bom`` puts a byte order mark before each header, so that spreadsheet programs take
    every part file as UTF-8.  A text with a line break raises unless ``line_breaks`` says
    that readers expect some.
    """
    def field(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return to_ptbr(f.name).alias(f.name)
        if isinstance(f.dataType, T.StringType) and not line_breaks:
            broken = F.col(f.name).rlike("[\\r\\n]")
            return F.when(broken, F.raise_error(F.lit(f"line break in {f.name}"))).otherwise(F.col(f.name)).alias(f.name)
        return F.col(f.name)

    text = df.select([field(f) for f in df.schema])
    if bom:
        first = text.columns[0]
        text = text.withColumnRenamed(first, BOM + first)
    text.write.csv(path, sep=";", header=True, encoding="UTF-8", quote='"', escape='"', dateFormat=ISO_DATE,
                   emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode=mode)


MANIFEST = "_manifest"


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """``arquivo``, ``linhas`` and ``soma`` of each part file: the lines, in any order, are summed as hashes."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("arquivo"), "value")
    return lines.groupBy("arquivo").agg(
        F.count("*").alias("linhas"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("soma"))


def seal(spark: SparkSession, path: str) -> None:
    """Lists the part files of a finished dataset with their lines and sums, beside them."""
    _contents(spark, path).coalesce(1).write.parquet(f"{path.rstrip('/')}/{MANIFEST}")


def verify(spark: SparkSession, path: str) -> None:
    """Raises if a part file of a sealed dataset is missing, changed or not listed, as a copy of one is."""
    listed = spark.read.parquet(f"{path.rstrip('/')}/{MANIFEST}").alias("listed")
    both = listed.join(_contents(spark, path).alias("found"), "arquivo", "full")
    wrong = both.filter(
        ~(F.col("listed.linhas").eqNullSafe(F.col("found.linhas")) & F.col("listed.soma").eqNullSafe(F.col("found.soma")))
    ).select("arquivo", F.when(F.col("found.linhas").isNull(), "missing").when(F.col("listed.linhas").isNull(), "not listed")
             .otherwise("changed").alias("how"))
    some = wrong.orderBy("arquivo").limit(10).collect()
    if some:
        raise ValueError(f"{path}: " + ", ".join(f"{row.arquivo} {row.how}" for row in some))


SEPARATED = {"sep": ";", "quote": '"', "escape": '"', "nullValue": NO_TEXT, "emptyValue": "",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
BAD_LINE = "_linha_ruim"
HEADER = "CABECALHO"


def _is_header(first: Column, written: list[str]) -> Column:
    """Whether a text is its file's header; raises if the first one has other names."""
    names = F.split(F.regexp_replace(F.regexp_replace("texto", f"^{BOM}", ""), '"', ""), ";")
    expected = F.array(*[F.lit(name.removeprefix(BOM)) for name in written])
    other = F.raise_error(F.concat("arquivo", F.lit(": another header"))).cast("boolean")
    return F.when(first, F.when(names == expected, F.lit(True)).otherwise(other)).otherwise(F.lit(False))


def read_apart(spark: SparkSession, path: str, schema: T.StructType,
               date_format: str = ISO_DATE) -> tuple[DataFrame, DataFrame]:
    """The rows that can be read, typed as ``read`` does, and the lines that cannot.

    A line is bad for its quotes (one is left open), its number of fields, or a value
    that doesn't fit its column.  Bad lines have ``arquivo``, ``bloco`` (the byte at which
    the part of the file that a task read begins), ``linha`` (the line's number in it, from
    0), ``motivo`` and ``texto``.  Every line but headers and empty ones is in one of both.
    Fields hold no line breaks.  A file whose header differs from the first one's raises.
    """
    written = _header(spark, path)
    plain = {name.removeprefix(BOM): name for name in written}
    missing = [f.name for f in schema if f.name not in plain]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("arquivo"), F.col("_metadata.file_block_start").alias("bloco"),
        F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\\r$", "").alias("texto"))
    # Lines are numbered as a task reads them; the first of each block is known from a count of one row a block.
    starts = lines.groupBy("arquivo", "bloco").agg(F.min("place").alias("first"))
    lines = lines.join(starts, ["arquivo", "bloco"]).withColumn("linha", F.col("place") - F.col("first"))
    is_header = _is_header((F.col("bloco") == 0) & (F.col("linha") == 0), written)
    fields = T.StructType([*[T.StructField(name, T.StringType()) for name in written], T.StructField(BAD_LINE, T.StringType())])
    options = SEPARATED | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    parsed = lines.filter(F.col("texto") != "").withColumn("fields", F.from_csv("texto", _ddl(fields), options))

    def typed(field: T.StructField):
        text = F.col("fields").getField(plain[field.name])
        if isinstance(field.dataType, T.DecimalType):
            return try_ptbr(text, field.dataType.simpleString()), text
        if isinstance(field.dataType, T.DateType):
            return F.try_to_date(text, date_format), text
        return text.try_cast(field.dataType), text

    pairs = [(f.name, *typed(f)) for f in schema]
    unfit = F.lit(None).cast("string")
    for name, value, text in reversed(pairs):
        unfit = F.when(text.isNotNull() & value.isNull(), F.lit(name)).otherwise(unfit)
    quotes = F.length("texto") - F.length(F.replace("texto", F.lit('"'), F.lit("")))
    # The header is judged with the rest, so that no filter on the reason comes before it.
    reason = (
        F.when(is_header, F.lit(HEADER)).when(quotes % 2 == 1, F.lit("ASPAS")).when(F.col("fields").getField(BAD_LINE).isNotNull(), F.lit("CAMPOS"))
        .when(unfit.isNotNull(), F.concat(F.lit("VALOR: "), unfit))
    )
    judged = parsed.withColumn("motivo", reason)
    good = judged.filter("motivo is null").select([value.alias(name) for name, value, _ in pairs])
    return good, judged.filter(F.col("motivo") != HEADER).select("arquivo", "bloco", "linha", "motivo", "texto")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def write_quarantine(spark: SparkSession, root: str, path: str, date_format: str = ISO_DATE) -> None:
    """Writes the bad lines of all eight tables as Parquet, one folder per table."""
    for name, schema in SCHEMAS.items():
        read_apart(spark, f"{root.rstrip('/')}/{name}", schema, date_format)[1].write.parquet(f"{path.rstrip('/')}/{name}")


def open_audit(spark: SparkSession, root: str, date_format: str = ISO_DATE, line_breaks: bool = False,
               leave_bad_lines: bool = False) -> Audit:
    """The eight tables as CSV folders (or files) below one root.

    ``leave_bad_lines``: lines that cannot be read are left out; see ``write_quarantine``.
    """
    if leave_bad_lines and line_breaks:
        raise ValueError("lines cannot be told apart where fields hold line breaks")

    def path(name: str) -> str:
        return f"{root.rstrip('/')}/{name}"

    def read_table(name: str, columns: tuple[str, ...]) -> DataFrame:
        if leave_bad_lines:
            return read_apart(spark, path(name), SCHEMAS[name], date_format)[0].select(*(columns or ["*"]))
        return read(spark, path(name), SCHEMAS[name], date_format, line_breaks).select(*(columns or ["*"]))

    def delivered(name: str, columns: tuple[str, ...]) -> DataFrame:
        return read_text(spark, path(name), SCHEMAS[name], line_breaks).select(*(columns or ["*"]))

    return Audit(spark, read_table, as_delivered=delivered)
