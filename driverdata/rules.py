"""The declared rules as the comparison knows them, written out apart from the product's own."""

from __future__ import annotations

from typing import NamedTuple


class ForeignKey(NamedTuple):
    table: str
    column: str
    parent: str
    parent_column: str

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}->{self.parent}.{self.parent_column}"


# Columns of each table; ``?`` marks one that may be null.
COLUMNS = {
    "contrato": "id_contrato valor data objeto id_entidade id_fornecedor",
    "empenho": "id_empenho ano data_empenho cpfcnpjcredor credor valor id_entidade id_contrato?",
    "liquidacao_nota_fiscal": "id_liq_empnf chave_danfe data_emissao valor id_empenho",
    "nfe": "id chave_nfe numero_nfe data_hora_emissao cnpj_emitente valor_total_nfe",
    "pagamento": "id_pagamento id_empenho datapagamentoemp valor",
    "nfe_pagamento": "id chave_nfe tipo_pagamento valor_pagamento",
    "fornecedor": "id_fornecedor nome documento",
    "entidade": "id_entidade nome estado municipio cnpj",
}
PRIMARY_KEYS = {table: columns.split()[0] for table, columns in COLUMNS.items()}
UNIQUE_COLUMNS = {"nfe": "chave_nfe", "nfe_pagamento": "chave_nfe", "fornecedor": "documento", "entidade": "cnpj"}
FOREIGN_KEYS = [ForeignKey(*line.split()) for line in """
contrato id_entidade entidade id_entidade
contrato id_fornecedor fornecedor id_fornecedor
empenho id_entidade entidade id_entidade
empenho id_contrato contrato id_contrato
liquidacao_nota_fiscal id_empenho empenho id_empenho
nfe chave_nfe nfe_pagamento chave_nfe
nfe chave_nfe liquidacao_nota_fiscal chave_danfe
pagamento id_empenho empenho id_empenho
""".strip().splitlines()]
TEXT_LENGTHS = {
    "contrato": {"objeto": 255},
    "empenho": {"id_empenho": 255, "cpfcnpjcredor": 20, "credor": 255},
    "liquidacao_nota_fiscal": {"chave_danfe": 50, "id_empenho": 255},
    "nfe": {"chave_nfe": 50, "numero_nfe": 50, "cnpj_emitente": 20},
    "pagamento": {"id_pagamento": 255, "id_empenho": 255},
    "nfe_pagamento": {"id": 255, "chave_nfe": 50, "tipo_pagamento": 50},
    "fornecedor": {"nome": 255, "documento": 20},
    "entidade": {"nome": 255, "estado": 50, "municipio": 100, "cnpj": 20},
}
MONEY = {"contrato": ["valor"], "empenho": ["valor"], "liquidacao_nota_fiscal": ["valor"], "nfe": ["valor_total_nfe"],
         "pagamento": ["valor"], "nfe_pagamento": ["valor_pagamento"]}
LARGEST_AMOUNT = "9999999999999.99"
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))


def required_columns(table: str) -> list[str]:
    return [c for c in COLUMNS[table].split() if not c.endswith("?")]


def money_columns(table: str) -> list[str]:
    return MONEY.get(table, [])
