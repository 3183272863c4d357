"""The eight audit tables: Spark types, keys, references and text lengths.

Column types are given explicitly and never inferred, because identifiers and
supplier documents have leading zeros.  Money is decimal(15,2), never double.
Numeric ids are long, so that more than 2^31 rows can be numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` must exist in ``parent.parent_column``; nulls are allowed."""

    table: str
    column: str
    parent: str
    parent_column: str

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}->{self.parent}.{self.parent_column}"


def _table(*columns: tuple[str, T.DataType], optional: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n in optional) for n, t in columns])


SCHEMAS: dict[str, T.StructType] = {
    "contrato": _table(
        ("id_contrato", T.LongType()),
        ("valor", MONEY),
        ("data", T.DateType()),
        ("objeto", T.StringType()),
        ("id_entidade", T.LongType()),
        ("id_fornecedor", T.LongType()),
    ),
    "empenho": _table(
        ("id_empenho", T.StringType()),
        ("ano", T.IntegerType()),
        ("data_empenho", T.DateType()),
        ("cpfcnpjcredor", T.StringType()),
        ("credor", T.StringType()),
        ("valor", MONEY),
        ("id_entidade", T.LongType()),
        ("id_contrato", T.LongType()),
        optional=("id_contrato",),
    ),
    "liquidacao_nota_fiscal": _table(
        ("id_liq_empnf", T.LongType()),
        ("chave_danfe", T.StringType()),
        ("data_emissao", T.DateType()),
        ("valor", MONEY),
        ("id_empenho", T.StringType()),
    ),
    "nfe": _table(
        ("id", T.LongType()),
        ("chave_nfe", T.StringType()),
        ("numero_nfe", T.StringType()),
        ("data_hora_emissao", T.TimestampNTZType()),
        ("cnpj_emitente", T.StringType()),
        ("valor_total_nfe", MONEY),
    ),
    "pagamento": _table(
        ("id_pagamento", T.StringType()),
        ("id_empenho", T.StringType()),
        ("datapagamentoemp", T.DateType()),
        ("valor", MONEY),
    ),
    "nfe_pagamento": _table(
        ("id", T.StringType()),
        ("chave_nfe", T.StringType()),
        ("tipo_pagamento", T.StringType()),
        ("valor_pagamento", MONEY),
    ),
    "fornecedor": _table(
        ("id_fornecedor", T.LongType()),
        ("nome", T.StringType()),
        ("documento", T.StringType()),
    ),
    "entidade": _table(
        ("id_entidade", T.LongType()),
        ("nome", T.StringType()),
        ("estado", T.StringType()),
        ("municipio", T.StringType()),
        ("cnpj", T.StringType()),
    ),
}

PRIMARY_KEYS: dict[str, str] = {
    "contrato": "id_contrato",
    "empenho": "id_empenho",
    "liquidacao_nota_fiscal": "id_liq_empnf",
    "nfe": "id",
    "pagamento": "id_pagamento",
    "nfe_pagamento": "id",
    "fornecedor": "id_fornecedor",
    "entidade": "id_entidade",
}

UNIQUE_COLUMNS: dict[str, str] = {
    "nfe": "chave_nfe",
    "nfe_pagamento": "chave_nfe",
    "fornecedor": "documento",
    "entidade": "cnpj",
}

FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("contrato", "id_entidade", "entidade", "id_entidade"),
    ForeignKey("contrato", "id_fornecedor", "fornecedor", "id_fornecedor"),
    ForeignKey("empenho", "id_entidade", "entidade", "id_entidade"),
    ForeignKey("empenho", "id_contrato", "contrato", "id_contrato"),
    ForeignKey("liquidacao_nota_fiscal", "id_empenho", "empenho", "id_empenho"),
    ForeignKey("nfe", "chave_nfe", "nfe_pagamento", "chave_nfe"),
    ForeignKey("nfe", "chave_nfe", "liquidacao_nota_fiscal", "chave_danfe"),
    ForeignKey("pagamento", "id_empenho", "empenho", "id_empenho"),
)

# Longest text each column may hold.
TEXT_LENGTHS: dict[str, dict[str, int]] = {
    "contrato": {"objeto": 255},
    "empenho": {"id_empenho": 255, "cpfcnpjcredor": 20, "credor": 255},
    "liquidacao_nota_fiscal": {"chave_danfe": 50, "id_empenho": 255},
    "nfe": {"chave_nfe": 50, "numero_nfe": 50, "cnpj_emitente": 20},
    "pagamento": {"id_pagamento": 255, "id_empenho": 255},
    "nfe_pagamento": {"id": 255, "chave_nfe": 50, "tipo_pagamento": 50},
    "fornecedor": {"nome": 255, "documento": 20},
    "entidade": {"nome": 255, "estado": 50, "municipio": 100, "cnpj": 20},
}


def required_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table] if not f.nullable]


def money_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table] if isinstance(f.dataType, T.DecimalType)]
