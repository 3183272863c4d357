"""The eight audit tables as projections of the driver's order tables.

Test input only; the product reads real audit tables (``lupafiscal.sources``).
The same projections stand in ``driverdata/oracle.py`` as SQL.  Nothing is
written or cached: each check plans straight down to the Parquet scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lupafiscal import session
from lupafiscal.audit import Audit

MONEY = "decimal(15,2)"


def _text(key: str) -> Column:
    return F.col(key).cast("string")


def _padded(key: Column, size: Column | int) -> Column:
    return F.lpad(key.cast("string"), size, F.lit("0"))


def _commitment_id(key: str) -> Column:
    return F.concat(F.lit("EMP-"), _text(key))


def _payment_id(order: str, line: str) -> Column:
    return F.concat(F.lit("PGT-"), _text(order), F.lit("-"), _text(line))


def _invoice_number() -> Column:
    step = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return F.col("l_orderkey") * 3 + step


def _invoice_key(number: Column) -> Column:
    return F.concat(F.lit("NFE"), _padded(number, 20))


class Mapping:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.root = spark, sf_dir.rstrip("/")
        self._base: dict[str, DataFrame] = {}
        self.tables: dict[str, Callable[[tuple[str, ...]], DataFrame]] = {
            "entidade": self.entidade,
            "fornecedor": self.fornecedor,
            "contrato": self.contrato,
            "empenho": self.empenho,
            "pagamento": self.pagamento,
            "liquidacao_nota_fiscal": self.liquidacao,
            "nfe": self.nfe,
            "nfe_pagamento": self.nfe_pagamento,
        }

    def read(self, name: str, columns: tuple[str, ...]) -> DataFrame:
        return self.tables[name](columns).select(*(columns or ["*"]))

    def base(self, name: str) -> DataFrame:
        if name not in self._base:  # the file footer is read once per audit
            self._base[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._base[name]

    def entidade(self, _: tuple[str, ...] = ()) -> DataFrame:
        nation, region = self.base("nation"), self.base("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("id_entidade"),
            F.col("n_name").alias("nome"),
            F.col("r_name").alias("estado"),
            F.col("n_name").alias("municipio"),
            _padded(F.col("n_nationkey"), 14).alias("cnpj"),
        )

    def fornecedor(self, _: tuple[str, ...] = ()) -> DataFrame:
        width = F.when(F.col("s_suppkey") % 10 == 0, 15).otherwise(14)
        return self.base("supplier").select(
            F.col("s_suppkey").alias("id_fornecedor"),
            F.col("s_name").alias("nome"),
            _padded(F.col("s_suppkey"), width).alias("documento"),
        )

    def _supplier_of_order(self) -> Column:
        return F.col("o_custkey") % self.base("supplier").agg(F.count("*")).scalar()

    def _orders(self) -> DataFrame:
        customer = self.base("customer")
        orders = self.base("orders")
        return orders.join(customer, orders.o_custkey == customer.c_custkey)

    def contrato(self, columns: tuple[str, ...] = ()) -> DataFrame:
        return self._orders().select(
            F.col("o_orderkey").alias("id_contrato"),
            F.col("o_totalprice").cast(MONEY).alias("valor"),
            F.col("o_orderdate").cast("date").alias("data"),
            F.col("o_orderpriority").alias("objeto"),
            F.col("c_nationkey").alias("id_entidade"),
            self._supplier_of_order().alias("id_fornecedor"),
        )

    def empenho(self, columns: tuple[str, ...] = ()) -> DataFrame:
        rows = self._orders().filter("o_orderkey % 50 <> 0")
        value = F.lit(None).cast(MONEY)
        if not columns or "valor" in columns:
            # only these orders take their lines' total as value
            lines = self.base("lineitem").filter("l_orderkey % 13 = 0")
            totals = lines.groupBy("l_orderkey").agg(
                F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("pago"))
            rows = rows.join(totals, rows.o_orderkey == totals.l_orderkey, "left")
            factor = (
                F.when(F.col("o_orderkey") % 3 == 0, F.lit("0.80"))
                .when(F.col("o_orderkey") % 3 == 1, F.lit("1.00"))
                .otherwise(F.lit("1.25"))
                .cast("decimal(3,2)")
            )
            priced = (F.col("o_totalprice").cast(MONEY) * factor).cast(MONEY)
            value = F.when((F.col("o_orderkey") % 13 == 0) & F.col("pago").isNotNull(),
                           F.col("pago")).otherwise(priced)
        return rows.select(
            _commitment_id("o_orderkey").alias("id_empenho"),
            F.year("o_orderdate").alias("ano"),
            F.date_add(F.col("o_orderdate").cast("date"),
                       (F.col("o_orderkey") % 15).cast("int")).alias("data_empenho"),
            _padded(self._supplier_of_order(), 14).alias("cpfcnpjcredor"),
            F.col("c_name").alias("credor"),
            value.alias("valor"),
            F.col("c_nationkey").alias("id_entidade"),
            F.col("o_orderkey").alias("id_contrato"),
        )

    def _paid_lines(self) -> DataFrame:
        lines = self.base("lineitem").filter("l_orderkey % 50 <> 0 and l_orderkey % 101 <> 0")
        return lines.groupBy("l_orderkey", "l_linenumber").agg(
            F.max("l_shipdate").cast("date").alias("datapagamentoemp"),
            F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("valor"))

    def pagamento(self, _: tuple[str, ...] = ()) -> DataFrame:
        return self._paid_lines().select(
            _payment_id("l_orderkey", "l_linenumber").alias("id_pagamento"),
            _commitment_id("l_orderkey").alias("id_empenho"),
            "datapagamentoemp",
            "valor",
        )

    def liquidacao(self, _: tuple[str, ...] = ()) -> DataFrame:
        """Lines are summed by order and flag before the orders come in."""
        number = _invoice_number()
        lines = self.base("lineitem").filter("l_orderkey % 50 <> 0")
        orders = self.base("orders").filter("o_orderstatus <> 'P'").select("o_orderkey")
        summed = lines.groupBy("l_orderkey", "l_returnflag").agg(
            F.min("l_shipdate").cast("date").alias("first"),
            F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("valor"))
        return summed.join(orders, summed.l_orderkey == orders.o_orderkey).select(
            number.alias("id_liq_empnf"),
            _invoice_key(number).alias("chave_danfe"),
            F.date_add("first", (F.col("l_orderkey") % 5).cast("int")).alias("data_emissao"),
            "valor",
            _commitment_id("l_orderkey").alias("id_empenho"),
        )

    def nfe(self, _: tuple[str, ...] = ()) -> DataFrame:
        liq = self.liquidacao().filter("id_liq_empnf % 10 <> 0")
        e = self.empenho(("id_empenho", "id_contrato")).select("id_empenho", "id_contrato")
        c = self.contrato().select("id_contrato", "id_fornecedor")
        f = self.fornecedor().select("id_fornecedor", "documento")
        extra = F.when(F.col("id_liq_empnf") % 97 == 0, 1).otherwise(0)
        # the contract and its supplier are joined per commitment, then the invoices
        return (
            liq.join(e.join(c, "id_contrato").join(f, "id_fornecedor"), "id_empenho")
            .select(
                F.col("id_liq_empnf").alias("id"),
                F.col("chave_danfe").alias("chave_nfe"),
                _text("id_liq_empnf").alias("numero_nfe"),
                F.col("data_emissao").cast("timestamp_ntz").alias("data_hora_emissao"),
                F.col("documento").alias("cnpj_emitente"),
                (F.col("valor") + extra).cast(MONEY).alias("valor_total_nfe"),
            )
        )

    def nfe_pagamento(self, _: tuple[str, ...] = ()) -> DataFrame:
        """Lines are reduced by order and flag before the orders come in."""
        kind = (
            F.when(F.col("l_orderkey") % 4 == 0, "BOLETO")
            .when(F.col("l_orderkey") % 4 == 1, "PIX")
            .when(F.col("l_orderkey") % 4 == 2, "TED")
            .otherwise("CHEQUE")
        )
        orders = self.base("orders").filter(
            "o_orderstatus = 'F' or (o_orderstatus = 'P' and o_orderkey % 7 = 0)").select("o_orderkey")
        last = self.base("lineitem").groupBy("l_orderkey", "l_returnflag").agg(
            F.max("l_linenumber").alias("l_linenumber"))
        links = last.join(orders, last.l_orderkey == orders.o_orderkey).groupBy("l_orderkey", "l_linenumber").agg(
            F.min(_invoice_key(_invoice_number())).alias("chave_nfe"),
            F.min(kind).alias("tipo_pagamento"))
        # numbers, by which both sides are grouped already, stand for the payment
        return links.join(self._paid_lines(), ["l_orderkey", "l_linenumber"]).select(
            _payment_id("l_orderkey", "l_linenumber").alias("id"),
            "chave_nfe",
            "tipo_pagamento",
            F.col("valor").alias("valor_pagamento"),
        )


BASE = ("region", "nation", "customer", "supplier", "orders", "lineitem")


def open_audit(spark: SparkSession, sf_dir: str) -> Audit:
    """Also fits the session's scan tasks and shuffle partitions to what is stored, as the command line does."""
    session.bound_tasks(spark, sum(session.stored_bytes(spark, f"{sf_dir.rstrip('/')}/{name}.parquet") for name in BASE))
    return Audit(spark, Mapping(spark, sf_dir).read)
