"""Small audit tables, and the comparison of a check with its SQL."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

import duckdb
import pyarrow as pa

from driverdata import oracle
from lupafiscal import Audit
from lupafiscal.schemas import SCHEMAS

DAY0 = date(2024, 1, 1)
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "date": pa.date32(),
         "timestamp_ntz": pa.timestamp("us"), "decimal(15,2)": pa.decimal128(15, 2)}


def d(day: int) -> date:
    return DAY0 + timedelta(days=day)


def m(amount: str | int) -> Decimal:
    return Decimal(amount).quantize(Decimal("0.01"))


def hand_made() -> dict[str, list[tuple]]:
    """One row for every branch, and the boundaries between them."""
    return {
        "entidade": [
            (1, "Prefeitura", "RJ", "Dados", "00000000000191"),
            (2, "Prefeitura", "SP", "Outra", "00000000000272"),
            (3, "Câmara", "RJ", "Dados", "00000000000353"),
        ],
        "fornecedor": [
            (10, "Alfa", "11222333000181"),
            (11, "João", "52998224725"),
            (12, "Alfa", "00000070000170"),
            (13, "Gama", "000001200001120"),
            (14, "Delta", "12A"),
        ],
        "contrato": [
            (10, m(100), d(10), "Obras", 1, 10),
            (11, m(100), d(20), "Obras", 2, 10),
            (12, m(50), d(30), "Merenda", 1, 12),
            (13, m(200), d(30), "TI", 3, 11),
            (14, m(80), d(30), "TI", 3, 13),
            (15, m(500), d(5), "Eventos", 2, 14),
        ],
        "empenho": [
            ("E1", 2024, d(12), "1", "A", m(100), 1, 10),
            ("E2", 2024, d(22), "1", "A", m(150), 2, 11),
            ("E3", 2024, d(25), "1", "A", m(40), 1, 12),
            ("E4", 2024, d(50), "1", "A", m(70), 1, None),
            ("E5", 2024, d(31), "1", "A", m(60), 3, 13),
            ("E6", 2024, d(31), "1", "A", m(60), 3, 13),
            ("E7", 2024, d(6), "1", "A", m(900), 2, 15),
            ("E8", 2024, d(40), "1", "A", m(100), 2, 11),
        ],
        "liquidacao_nota_fiscal": [
            (1, "N1", d(11), m(60), "E1"),
            (2, "N2", d(14), m(60), "E1"),
            (3, "N3", d(33), m(40), "E5"),
            (4, "N4", d(22), m(30), "E3"),
            (5, "N4", d(9), m(30), "E3"),
            (6, "N9", d(41), m(5), "E8"),
        ],
        "nfe": [
            (1, "N1", "1", datetime(2024, 1, 12), "11222333000181", m(60)),
            (2, "N3", "3", datetime(2024, 2, 3), "52998224725", m("40.01")),
            (3, "N4", "4", datetime(2024, 1, 23), "00000070000170", m(30)),
        ],
        "pagamento": [
            ("P1", "E1", d(10), m(100)),      # on the contract's first day, at its value
            ("P2", "E1", d(9), m("100.01")),  # a day before, a cent above
            ("P3", "E2", d(21), m(120)),
            ("P4", "E2", d(19), m(30)),       # E2 paid exactly
            ("P5", "E3", d(22), m(60)),
            ("P6", "E4", d(40), m(10)),       # no contract, before its commitment
            ("P7", "E7", d(5), m(500)),
            ("P8", "E8", d(41), m(100)),
            ("P9", "E8", d(20), m(100)),
        ],
        "nfe_pagamento": [
            ("P1", "N1", "BOLETO", m(100)),
            ("P3", "N2", "PIX", m(120)),
            ("X1", "N7", "PIX", m(60)),       # amount of an unrelated payment
            ("X2", "N8", "PIX", m(60)),
            ("X3", "N5", "TED", m(7)),
        ],
    }


def random_tables(seed: int, size: int) -> dict[str, list[tuple]]:
    """Few days, amounts and keys, so that ties, orphans and repeats are frequent."""
    r = random.Random(seed)

    def amount() -> Decimal:
        return m(r.choice(["10", "20", "20.01", "35.5", "50", "99.99", "120"]))

    def day() -> date:
        return d(r.randrange(12))

    def e_id() -> str:
        return f"E{min(r.randrange(size), r.randrange(size + 3))}"

    entities = [(i, f"Entidade {i % 3}", "RJ", "X", f"{i:014d}") for i in range(5)]
    suppliers = [(i, f"Fornecedor {i % 4}", f"{i:014d}") for i in range(7)]
    contracts = [(i, amount(), day(), f"Objeto {r.randrange(4)}", r.randrange(6), r.randrange(8))
                 for i in range(size)]
    commitments = [(f"E{i}", 2024, day(), "1", "A", amount(), r.randrange(5),
                    r.choice([None, r.randrange(size + 2), r.randrange(size)])) for i in range(size)]
    deliveries = [(i, f"N{r.randrange(size * 2)}", day(), amount(), e_id()) for i in range(size)]
    invoices = [(i, f"N{i}", str(i), datetime(2024, 1, 1 + r.randrange(12)),
                 f"{r.randrange(8):014d}", amount()) for i in range(size)]
    paid = [(f"P{i}", e_id(), day(), amount()) for i in range(size * 2)]
    links = [(f"P{i * 3}", f"N{i + size // 2}", r.choice(["PIX", "TED", "BOLETO"]), amount())
             for i in range(size)]
    return {"entidade": entities, "fornecedor": suppliers, "contrato": contracts,
            "empenho": commitments, "liquidacao_nota_fiscal": deliveries, "nfe": invoices,
            "pagamento": paid, "nfe_pagamento": links}


def dirty_tables() -> dict[str, list[tuple]]:
    """Breaks every declared rule once or more."""
    t = hand_made()
    t["pagamento"] += [("P1", "E1", d(1), m(1)), ("P1", None, d(1), m(1)), (None, "E404", None, None),
                       (None, "E404", d(2), m(2))]
    t["fornecedor"] += [(10, None, "11222333000181"), (15, "N" * 256, "1" * 21)]
    t["nfe"] += [(3, "N1", "1" * 51, None, "1", m(1))]
    t["nfe_pagamento"] += [("P1", "N1", "PIX", m(1)), ("P2", None, "PIX", None)]
    t["contrato"] += [(16, m(1), d(1), "x" * 300, None, 99), (16, m(1), d(1), "x", 99, 99)]
    t["empenho"] += [("E1", None, None, "2" * 21, "A", None, None, 404)]
    t["entidade"] += [(None, "Sem número", "RJ", "m" * 101, "00000000000191")]
    t["liquidacao_nota_fiscal"] += [(1, None, d(1), m(1), "E404")]
    return t


def audit(spark, tables: dict[str, list[tuple]]) -> Audit:
    from pyspark.sql.types import StructField, StructType

    def nullable(schema: StructType) -> StructType:
        return StructType([StructField(f.name, f.dataType, True) for f in schema])

    return Audit.over(spark, {
        name: spark.createDataFrame(tables[name], nullable(schema)) for name, schema in SCHEMAS.items()
    })


def database(tables: dict[str, list[tuple]]) -> duckdb.DuckDBPyConnection:
    """In this process and in memory only."""
    con = duckdb.connect()
    for name, schema in SCHEMAS.items():
        columns = list(zip(*tables[name]))
        data = pa.table({f.name: pa.array(columns[i], ARROW[f.dataType.simpleString()])
                         for i, f in enumerate(schema)})
        con.register(name, data)
    return con


SQL = oracle.all_sql(oracle.VIEWS)


def rows_of(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(row[c] for c in columns) for row in df.collect())


def rows_of_sql(con: duckdb.DuckDBPyConnection, name: str) -> tuple[list[str], Counter]:
    result = con.execute(SQL[name])
    names = [c[0] for c in result.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, Counter(tuple(row[i] for i in order) for row in result.fetchall())
