"""The checks as plain SQL over the driver's tables, for comparison in DuckDB.

``TABLES`` are the audit tables as SQL, ``VIEWS`` what several checks start
from.  Each check lists only its own SELECT; the needed definitions are put in
front.  Quoted labels and column names are fixed values.  Rows are paired here
where the Spark job counts and multiplies, so the comparison also tests that
rewriting.
"""

from __future__ import annotations

import re

from driverdata.rules import (
    CNPJ_WEIGHTS,
    COLUMNS,
    CPF_WEIGHTS,
    FOREIGN_KEYS,
    LARGEST_AMOUNT,
    PRIMARY_KEYS,
    TEXT_LENGTHS,
    UNIQUE_COLUMNS,
    ForeignKey,
    money_columns,
    required_columns,
)

FLAG_STEP = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
SUPPLIER_OF_ORDER = "o_custkey % (SELECT COUNT(*) FROM supplier)"

TABLES = {
    "entidade": """
        SELECT n_nationkey AS id_entidade, n_name AS nome, r_name AS estado, n_name AS municipio,
               lpad(CAST(n_nationkey AS VARCHAR(20)), 14, '0') AS cnpj
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "fornecedor": """
        SELECT s_suppkey AS id_fornecedor, s_name AS nome,
               lpad(CAST(s_suppkey AS VARCHAR(20)),
                    CASE WHEN s_suppkey % 10 = 0 THEN 15 ELSE 14 END, '0') AS documento
        FROM supplier""",
    "contrato": f"""
        SELECT o_orderkey AS id_contrato, CAST(o_totalprice AS DECIMAL(15,2)) AS valor,
               CAST(o_orderdate AS DATE) AS data, o_orderpriority AS objeto,
               c_nationkey AS id_entidade, {SUPPLIER_OF_ORDER} AS id_fornecedor
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "empenho": f"""
        SELECT 'EMP-' || CAST(o_orderkey AS VARCHAR(20)) AS id_empenho, year(o_orderdate) AS ano,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 AS INT) AS data_empenho,
               lpad(CAST({SUPPLIER_OF_ORDER} AS VARCHAR(20)), 14, '0') AS cpfcnpjcredor,
               c_name AS credor,
               CASE WHEN o_orderkey % 13 = 0 AND pago IS NOT NULL THEN pago
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2))
                              * CASE o_orderkey % 3 WHEN 0 THEN 0.80 WHEN 1 THEN 1.00 ELSE 1.25 END
                              AS DECIMAL(15,2)) END AS valor,
               c_nationkey AS id_entidade, o_orderkey AS id_contrato
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT l_orderkey,
                          CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS pago
                   FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey
        WHERE o_orderkey % 50 <> 0""",
    "pagamento": """
        SELECT 'PGT-' || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20))
                   AS id_pagamento,
               'EMP-' || CAST(l_orderkey AS VARCHAR(20)) AS id_empenho,
               CAST(MAX(l_shipdate) AS DATE) AS datapagamentoemp,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS valor
        FROM lineitem WHERE l_orderkey % 50 <> 0 AND l_orderkey % 101 <> 0
        GROUP BY l_orderkey, l_linenumber""",
    "liquidacao_nota_fiscal": f"""
        SELECT l_orderkey * 3 + {FLAG_STEP} AS id_liq_empnf,
               'NFE' || lpad(CAST(l_orderkey * 3 + {FLAG_STEP} AS VARCHAR(20)), 20, '0')
                   AS chave_danfe,
               CAST(MIN(l_shipdate) AS DATE) + CAST(l_orderkey % 5 AS INT) AS data_emissao,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS valor,
               'EMP-' || CAST(l_orderkey AS VARCHAR(20)) AS id_empenho
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderstatus <> 'P' AND l_orderkey % 50 <> 0
        GROUP BY l_orderkey, l_returnflag""",
    "nfe": """
        SELECT id_liq_empnf AS id, chave_danfe AS chave_nfe,
               CAST(id_liq_empnf AS VARCHAR(20)) AS numero_nfe,
               CAST(l.data_emissao AS TIMESTAMP) AS data_hora_emissao,
               documento AS cnpj_emitente,
               CAST(l.valor + CASE WHEN id_liq_empnf % 97 = 0 THEN 1 ELSE 0 END AS DECIMAL(15,2))
                   AS valor_total_nfe
        FROM liquidacao_nota_fiscal l
        JOIN empenho e ON e.id_empenho = l.id_empenho
        JOIN contrato c ON c.id_contrato = e.id_contrato
        JOIN fornecedor f ON f.id_fornecedor = c.id_fornecedor
        WHERE id_liq_empnf % 10 <> 0""",
    "nfe_pagamento": f"""
        SELECT g.id, MIN(g.chave_nfe) AS chave_nfe, MIN(g.tipo_pagamento) AS tipo_pagamento,
               p.valor AS valor_pagamento
        FROM (SELECT 'PGT-' || CAST(l_orderkey AS VARCHAR(20)) || '-'
                         || CAST(MAX(l_linenumber) AS VARCHAR(20)) AS id,
                     'NFE' || lpad(CAST(l_orderkey * 3 + {FLAG_STEP} AS VARCHAR(20)), 20, '0')
                         AS chave_nfe,
                     CASE l_orderkey % 4 WHEN 0 THEN 'BOLETO' WHEN 1 THEN 'PIX' WHEN 2 THEN 'TED'
                                         ELSE 'CHEQUE' END AS tipo_pagamento
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              WHERE o_orderstatus = 'F' OR (o_orderstatus = 'P' AND l_orderkey % 7 = 0)
              GROUP BY l_orderkey, l_returnflag) g
        JOIN pagamento p ON p.id_pagamento = g.id
        GROUP BY g.id, p.valor""",
}

VIEWS = {
    # payment with commitment and contract
    "ciclo": """
        SELECT p.id_pagamento, p.datapagamentoemp AS dia, p.valor AS pago, e.id_empenho,
               e.valor AS reservado, e.data_empenho AS emissao_empenho, c.*
        FROM (SELECT id_contrato, valor AS teto, data AS inicio, objeto, id_entidade, id_fornecedor
              FROM contrato) c, empenho e, pagamento p
        WHERE c.id_contrato = e.id_contrato AND e.id_empenho = p.id_empenho""",
    # payment with commitment only
    "emp_pag": """
        SELECT p.id_pagamento, p.datapagamentoemp AS dia, p.valor AS pago, e.id_empenho,
               e.valor AS reservado, e.data_empenho AS emissao_empenho, e.id_contrato
        FROM empenho e, pagamento p WHERE e.id_empenho = p.id_empenho""",
    "liquidados": "SELECT DISTINCT id_empenho FROM liquidacao_nota_fiscal",
    "com_nota": """
        SELECT DISTINCT id_empenho FROM liquidacao_nota_fiscal
        WHERE chave_danfe IN (SELECT chave_nfe FROM nfe)""",
    "aberto": """
        SELECT * FROM ciclo
        WHERE id_empenho NOT IN (FROM liquidados) AND id_pagamento NOT IN (SELECT id FROM nfe_pagamento)""",
    "pago_por_empenho": """
        SELECT id_empenho, COUNT(*) AS n, SUM(valor) AS soma, MAX(datapagamentoemp) AS ultimo
        FROM pagamento GROUP BY id_empenho""",
    "liq_por_empenho": """
        SELECT id_empenho, COUNT(*) AS n, SUM(valor) AS soma, MIN(data_emissao) AS primeira
        FROM liquidacao_nota_fiscal GROUP BY id_empenho""",
    "irregular": """
        SELECT en.nome AS entidade_responsavel, f.nome AS fornecedor, objeto AS objeto_contrato,
               k.id_empenho, k.id_contrato, teto AS valor_teto_contrato, pago AS valor_total_pago,
               IF(pago > teto, 'Sobrepreço (Acima do Contrato)',
                  'Pagamento Sem Liquidação (Fantasma)') AS tipo_irregularidade,
               CAST(IF(pago > teto, pago - teto, pago) AS DECIMAL(18,2)) AS valor_prejuizo_estimado
        FROM ciclo k
        JOIN entidade en USING (id_entidade)
        JOIN fornecedor f USING (id_fornecedor)
        LEFT JOIN (SELECT id_empenho AS liq FROM liquidacao_nota_fiscal) l ON liq = k.id_empenho
        WHERE pago > teto OR liq IS NULL""",
    "risco_fornecedor": """
        SELECT k.*, f.nome, f.documento, GREATEST(s.soma - teto, 0) AS excesso,
               ROW_NUMBER() OVER (PARTITION BY k.id_empenho ORDER BY k.id_pagamento) AS ordem
        FROM ciclo k JOIN fornecedor f USING (id_fornecedor)
        JOIN pago_por_empenho s ON s.id_empenho = k.id_empenho""",
    "par": """
        SELECT k.*, l.id_liq_empnf, l.chave_danfe, l.data_emissao
        FROM ciclo k JOIN liquidacao_nota_fiscal l ON l.id_empenho = k.id_empenho""",
    "divergente": """
        SELECT f.nome, n.numero_nfe, n.valor_total_nfe, l.valor, e.id_empenho
        FROM liquidacao_nota_fiscal l JOIN nfe n ON n.chave_nfe = l.chave_danfe
        JOIN empenho e ON e.id_empenho = l.id_empenho
        JOIN fornecedor f ON f.documento = n.cnpj_emitente
        WHERE l.valor <> n.valor_total_nfe""",
    "acima_das_notas": """
        SELECT e.id_empenho, f.nome, SUM(l.valor) AS notas, SUM(p.valor) AS banco
        FROM pagamento p JOIN liquidacao_nota_fiscal l USING (id_empenho)
        JOIN empenho e USING (id_empenho) JOIN fornecedor f ON f.id_fornecedor = e.id_contrato
        GROUP BY ALL HAVING SUM(p.valor) > SUM(l.valor)""",
    "suspeito": """
        SELECT tipo_pagamento, COUNT(*) AS n, SUM(valor_pagamento) AS volume FROM nfe_pagamento
        WHERE valor_pagamento IN (SELECT pago FROM ciclo WHERE pago > teto) GROUP BY tipo_pagamento""",
    "orfao": """
        SELECT chave_nfe, tipo_pagamento, valor_pagamento FROM nfe_pagamento
        WHERE chave_nfe NOT IN (SELECT chave_danfe FROM liquidacao_nota_fiscal)""",
    "problema": """
        SELECT * FROM ciclo WHERE pago > teto OR id_empenho NOT IN (FROM liquidados)""",
    "antecipado": "SELECT * FROM ciclo WHERE dia < inicio",
    "precoce": "SELECT * FROM emp_pag WHERE emissao_empenho > dia",
    "acima": "SELECT * FROM ciclo WHERE pago > teto",
}

DEFINITIONS = {**TABLES, **VIEWS}


def with_definitions(select: str, definitions: dict[str, str] = DEFINITIONS) -> str:
    """Puts the definitions ``select`` needs, and those they need, in front of it."""
    def used(text: str) -> list[str]:
        return [n for n in definitions if re.search(rf"(?<![\w.'-]){n}\b(?!['.])", text)]

    order: list[str] = []

    def place(name: str) -> None:
        for other in used(definitions[name]):
            if other != name:
                place(other)
        if name not in order:
            order.append(name)

    for name in used(select):
        place(name)
    if not order:
        return select.strip()
    ctes = ",\n".join(f"{name} AS ({definitions[name].strip()})" for name in order)
    return f"WITH {ctes}\n{select.strip()}"


SELECTS: dict[str, str] = {
    "q01_total_commitments": "SELECT COUNT(*) AS total_empenhos FROM empenho",
    "q02_commitments_with_payment":
        "SELECT COUNT(DISTINCT id_empenho) AS total_empenhos_com_pagamento FROM pagamento",
    "q03_full_cycle_commitments": """
        SELECT COUNT(DISTINCT e.id_empenho) AS total_empenhos_regulares FROM emp_pag e
        JOIN liquidacao_nota_fiscal l ON l.id_empenho = e.id_empenho""",
    "q04_payments_without_liquidation": """
        SELECT DISTINCT id_empenho, id_pagamento, pago AS valor_pago FROM emp_pag
        WHERE id_empenho NOT IN (FROM liquidados)""",
    "q05_invoice_status_of_unliquidated": """
        SELECT IF(id_pagamento IN (SELECT id FROM nfe_pagamento WHERE chave_nfe IS NOT NULL),
                  'COM_NFE_VINCULADA', 'SEM_NFE_VINCULADA') AS status_fiscal,
               COUNT(DISTINCT id_pagamento) AS qtd_pagamentos
        FROM emp_pag WHERE id_empenho NOT IN (FROM liquidados) GROUP BY status_fiscal""",
    "q06_total_contracts": "SELECT COUNT(*) AS total_contratos FROM contrato",
    "q07_fiscal_integrity": """
        SELECT k.id_empenho, k.id_pagamento, k.pago AS valor_pago,
               l.id_liq_empnf AS registro_liquidacao, l.chave_danfe AS chave_nfe_liquidacao,
               IF(n.chave_nfe IS NULL, 'PENDENTE DE VINCULAÇÃO FISCAL (SEM NF-E NO PAGAMENTO)',
                  'CONCLUÍDO COM NF-E') AS status_integridade_fiscal
        FROM emp_pag k JOIN liquidacao_nota_fiscal l ON l.id_empenho = k.id_empenho
        LEFT JOIN nfe_pagamento n ON n.id = k.id_pagamento""",
    "q08_open_paid_totals": """
        SELECT id_contrato, id_empenho, f.nome AS fornecedor,
               CAST(SUM(pago) AS DECIMAL(38,2)) AS total_pago_em_aberto
        FROM aberto JOIN fornecedor f USING (id_fornecedor) GROUP BY ALL""",
    "q09_contracts_without_commitment": """
        SELECT id_contrato, valor AS valor_contrato, CAST(NULL AS VARCHAR) AS id_empenho,
               'SEM_EMPENHO' AS status_contrato_empenho
        FROM contrato WHERE id_contrato NOT IN
            (SELECT id_contrato FROM empenho WHERE id_contrato IS NOT NULL)""",
    "q10_contracts_without_commitment_registry": """
        SELECT c.id_contrato, c.objeto, en.nome AS nome_entidade, f.nome AS nome_fornecedor
        FROM contrato c JOIN entidade en USING (id_entidade) JOIN fornecedor f USING (id_fornecedor)
        WHERE c.id_contrato NOT IN (SELECT id_contrato FROM empenho WHERE id_contrato IS NOT NULL)""",
    "q11_commitment_vs_contract": """
        SELECT CASE SIGN(reservado - teto) WHEN 1 THEN 'EMPENHO_SUPERIOR_AO_CONTRATO'
                    WHEN -1 THEN 'EMPENHO_INFERIOR_AO_CONTRATO'
                    ELSE 'EMPENHO_IGUAL_AO_CONTRATO' END AS relacao_empenho_contrato,
               COUNT(DISTINCT id_empenho) AS quantidade_empenhos,
               CAST(SUM(reservado) AS DECIMAL(38,2)) AS total_reservado,
               CAST(SUM(teto) AS DECIMAL(38,2)) AS total_contratado
        FROM aberto GROUP BY 1""",
    "q12_real_excess_paid": """
        SELECT id_empenho, f.nome AS fornecedor, teto AS valor_contrato, reservado AS valor_empenhado,
               CAST(reservado - teto AS DECIMAL(18,2)) AS excesso_no_empenho,
               CAST(SUM(pago) AS DECIMAL(38,2)) AS total_ja_pago,
               CAST(SUM(pago) - teto AS DECIMAL(38,2)) AS excesso_pago_real
        FROM aberto JOIN fornecedor f USING (id_fornecedor)
        WHERE reservado > teto GROUP BY id_empenho, f.nome, teto, reservado""",
    "q13_open_payment_dates": """
        SELECT IF(dia < inicio, 'PAGOU_ANTES_DO_CONTRATO', 'PAGOU_DURANTE_VIGENCIA') AS checagem_data,
               COUNT(*) AS qtd_pagamentos
        FROM aberto GROUP BY 1""",
    "q14_paid_before_commitment": """
        SELECT id_empenho, emissao_empenho AS data_empenho, dia AS datapagamentoempenho FROM precoce""",
    "q15_paid_before_commitment_and_contract": """
        SELECT id_empenho, f.nome AS fornecedor, inicio AS data_inicio_contrato,
               emissao_empenho AS data_empenho, dia AS data_pagamento,
               CAST(inicio - dia AS INT) AS dias_pagou_antes_do_contrato, pago AS valor
        FROM antecipado JOIN fornecedor f USING (id_fornecedor) WHERE emissao_empenho > dia""",
    "q16_early_payment_vs_liquidation": """
        SELECT CASE WHEN l.data_emissao IS NULL THEN 'SEM_LIQUIDACAO'
                    WHEN l.data_emissao > dia THEN 'PAGOU_ANTES_DE_LIQUIDAR (GRAVÍSSIMO)'
                    ELSE 'LIQUIDOU_ANTES_MAS_EMPENHOU_DEPOIS (ERRO_CONTABIL)' END
                   AS tipo_inconsistencia,
               COUNT(*) AS qtd_casos, CAST(SUM(pago) AS DECIMAL(38,2)) AS total_envolvido
        FROM precoce k LEFT JOIN liquidacao_nota_fiscal l ON l.id_empenho = k.id_empenho GROUP BY 1""",
    "q17_paid_over_commitment": """
        SELECT id_empenho, reservado AS valor_empenhado, CAST(SUM(pago) AS DECIMAL(38,2)) AS total_pago,
               CAST(SUM(pago) - reservado AS DECIMAL(38,2)) AS diferenca
        FROM emp_pag GROUP BY id_empenho, reservado HAVING SUM(pago) > reservado""",
    "q18_commitment_payment_status": """
        SELECT CASE SIGN(COALESCE(soma, 0) - valor) WHEN 1 THEN 'PAGO_A_MAIOR'
                    WHEN 0 THEN 'DEVIDAMENTE_PAGO' ELSE 'NAO_DEVIDAMENTE_PAGO' END AS status_pagamento,
               COUNT(*) AS quantidade_empenhos
        FROM empenho e LEFT JOIN pago_por_empenho s ON s.id_empenho = e.id_empenho GROUP BY 1""",
    "q19_liquidation_to_payment_days": """
        SELECT k.id_empenho, MIN(l.data_emissao) AS data_liquidacao, MAX(k.dia) AS data_pagamento,
               CAST(MAX(k.dia) - MIN(l.data_emissao) AS INT) AS dias_entre_liquidacao_e_pagamento
        FROM emp_pag k JOIN liquidacao_nota_fiscal l ON l.id_empenho = k.id_empenho
        GROUP BY k.id_empenho""",
    "q20_finished_payment_dates": """
        SELECT CASE WHEN dia < inicio THEN 'PAGAMENTO_ANTES_DA_VIGENCIA'
                    WHEN dia > inicio THEN 'PAGAMENTO_DURANTE_VIGENCIA'
                    ELSE 'PAGAMENTO_NO_INICIO_DA_VIGENCIA' END AS status_temporal_pagamento,
               COUNT(*) AS quantidade_pagamentos, CAST(SUM(pago) AS DECIMAL(38,2)) AS total_pago
        FROM ciclo WHERE id_empenho IN (FROM liquidados) AND id_empenho IN (FROM com_nota) GROUP BY 1""",
    "q21_commitments_without_payment": """
        SELECT COUNT(*) AS empenhos_sem_pagamento FROM empenho
        WHERE id_empenho NOT IN (SELECT id_empenho FROM pagamento)""",
    "q22_finished_without_payment": """
        SELECT COUNT(*) AS finalizados_sem_pagamento FROM empenho
        WHERE id_empenho IN (FROM com_nota) AND id_empenho NOT IN (SELECT id_empenho FROM pagamento)""",
    "q23_full_advances": """
        SELECT COUNT(DISTINCT id_empenho) AS qtd_empenhos, COUNT(id_pagamento) AS qtd_pagamentos,
               CAST(SUM(pago) AS DECIMAL(38,2)) AS total_pago
        FROM par WHERE dia < inicio AND dia < data_emissao""",
    "q24_payment_over_ceiling_summary": """
        SELECT CASE WHEN pago > teto THEN 'PAGAMENTO_MAIOR_QUE_CONTRATO'
                    WHEN pago <= reservado THEN 'PAGAMENTO_DENTRO_DO_LIMITE'
                    ELSE 'PAGAMENTO_MAIOR_QUE_EMPENHO' END AS status_pagamento,
               COUNT(*) AS quantidade_pagamentos, CAST(SUM(pago) AS DECIMAL(38,2)) AS total_pago
        FROM ciclo GROUP BY 1""",
    "q25_over_contract_by_validity": """
        SELECT CASE WHEN dia < inicio THEN 'ANTES_DA_VIGENCIA' WHEN dia > inicio THEN 'DURANTE_A_VIGENCIA'
                    ELSE 'NO_INICIO_DA_VIGENCIA' END AS status_vigencia_pagamento,
               COUNT(*) AS quantidade_pagamentos, CAST(SUM(pago) AS DECIMAL(38,2)) AS total_pago
        FROM acima GROUP BY 1""",
    "q26_over_contract_by_liquidation": """
        SELECT IF(id_empenho IN (FROM liquidados), 'COM_LIQUIDACAO', 'SEM_LIQUIDACAO')
                   AS status_liquidacao,
               COUNT(*) AS quantidade_pagamentos, CAST(SUM(pago) AS DECIMAL(38,2)) AS total_pago
        FROM acima GROUP BY 1""",
    "q27_total_suppliers": "SELECT COUNT(*) AS total_fornecedores FROM fornecedor",
    "q28_contracts_per_supplier": """
        SELECT id_fornecedor, nome AS nome_fornecedor,
               (SELECT COUNT(*) FROM contrato c WHERE c.id_fornecedor = f.id_fornecedor)
                   AS quantidade_contratos
        FROM fornecedor f""",
    "q29_critical_cases": """
        SELECT DISTINCT id_empenho, reservado AS valor_empenhado, teto AS valor_contrato,
               pago AS valor_pago, CAST(pago - teto AS DECIMAL(18,2)) AS valor_excedente,
               f.nome AS nome_fornecedor, en.nome AS orgao_pagador
        FROM acima JOIN fornecedor f USING (id_fornecedor) JOIN entidade en USING (id_entidade)
        WHERE id_empenho NOT IN (FROM liquidados)""",
    "q30_paid_over_invoices": """
        SELECT id_empenho, nome AS fornecedor, CAST(notas AS DECIMAL(38,2)) AS total_nota_fiscal,
               CAST(banco AS DECIMAL(38,2)) AS total_pago_banco,
               CAST(banco - notas AS DECIMAL(38,2)) AS diferenca_indevida
        FROM acima_das_notas""",
    "q30b_paid_over_invoices_corrected": """
        SELECT e.id_empenho, f.nome AS fornecedor, CAST(l.soma AS DECIMAL(38,2)) AS total_nota_fiscal,
               CAST(p.soma AS DECIMAL(38,2)) AS total_pago_banco,
               CAST(p.soma - l.soma AS DECIMAL(38,2)) AS diferenca_indevida
        FROM empenho e JOIN contrato c USING (id_contrato)
        JOIN fornecedor f ON f.id_fornecedor = c.id_fornecedor
        JOIN pago_por_empenho p ON p.id_empenho = e.id_empenho
        JOIN liq_por_empenho l ON l.id_empenho = e.id_empenho
        WHERE p.soma > l.soma""",
    "q31_invoice_divergence": """
        SELECT nome AS fornecedor, numero_nfe, valor_total_nfe AS valor_real_da_nota,
               valor AS valor_lancado_no_sistema,
               CAST(valor_total_nfe - valor AS DECIMAL(18,2)) AS divergencia_fiscal, id_empenho
        FROM divergente""",
    "q32_modus_operandi": """
        SELECT tipo_pagamento, n AS frequencia,
               CAST(volume AS DECIMAL(38,2)) AS volume_financeiro_suspeito FROM suspeito""",
    "q33_entity_impact": """
        SELECT en.nome AS entidade_responsavel,
               COUNT(DISTINCT id_empenho) AS qtd_empenhos_problematicos,
               CAST(SUM(IF(pago > teto, pago - teto, pago)) AS DECIMAL(38,2)) AS total_risco_financeiro
        FROM problema JOIN entidade en USING (id_entidade) GROUP BY en.nome""",
    "q34_supplier_dossier": """
        SELECT f.nome AS fornecedor, f.documento AS cnpj,
               CAST(SUM(pago) AS DECIMAL(38,2)) AS total_recebido,
               CAST(SUM(pago) - SUM(DISTINCT teto) AS DECIMAL(38,2)) AS saldo_excedente_recebido,
               COUNT(*) FILTER (dia < inicio) AS qtd_pagamentos_antecipados
        FROM ciclo k JOIN fornecedor f ON f.id_fornecedor = k.id_fornecedor
        GROUP BY f.id_fornecedor, f.nome, f.documento""",
    "q35_orphan_invoice_payments": """
        SELECT chave_nfe, tipo_pagamento, valor_pagamento AS valor_nfe_pagamento,
               'REGISTRO ORFÃO (SEM LIQUIDAÇÃO VINCULADA)' AS status_auditoria FROM orfao""",
    "g02_early_payment_timeline": """
        SELECT f.nome AS fornecedor, en.nome AS entidade, id_contrato, inicio AS data_inicio_contrato,
               dia AS data_pagamento, CAST(inicio - dia AS INT) AS dias_antecipacao,
               pago AS valor_pago_indevido,
               'PAGAMENTO ANTECIPADO (Antes da vigência)' AS gravidade_temporal
        FROM antecipado JOIN fornecedor f USING (id_fornecedor) JOIN entidade en USING (id_entidade)""",
    "g03_consolidated_impact": """
        SELECT id_empenho, nome AS entidade_responsavel,
               IF(soma > teto, 'Sobrepreço Contratual', 'Pagamento Sem Liquidação') AS categoria_risco,
               CAST(IF(soma > teto, soma - teto, soma) AS DECIMAL(38,2)) AS valor_risco_financeiro
        FROM (SELECT k.id_empenho, en.nome, teto, SUM(pago) AS soma, COUNT(liq) AS notas
              FROM ciclo k JOIN entidade en USING (id_entidade)
              LEFT JOIN (SELECT id_empenho AS liq FROM liquidacao_nota_fiscal) l ON liq = k.id_empenho
              GROUP BY k.id_empenho, en.nome, teto)
        WHERE soma > teto OR notas = 0""",
    "g03b_consolidated_impact_once": """
        SELECT id_empenho, nome AS entidade_responsavel,
               IF(soma > teto, 'Sobrepreço Contratual', 'Pagamento Sem Liquidação') AS categoria_risco,
               CAST(IF(soma > teto, soma - teto, soma) AS DECIMAL(38,2)) AS valor_risco_financeiro
        FROM (SELECT id_empenho, en.nome, teto, SUM(pago) AS soma
              FROM ciclo JOIN entidade en USING (id_entidade) GROUP BY id_empenho, en.nome, teto)
        WHERE soma > teto OR id_empenho NOT IN (FROM liquidados)""",
    "g04_supplier_risk_ranking": """
        SELECT nome AS fornecedor, documento AS cnpj,
               CAST(SUM(excesso) AS DECIMAL(38,2)) AS saldo_excedente_recebido,
               COUNT(*) FILTER (dia < inicio) AS qtd_pagamentos_antecipados,
               CAST(SUM(pago) AS DECIMAL(38,2)) AS total_recebido_geral
        FROM risco_fornecedor GROUP BY nome, documento""",
    "g04b_supplier_risk_ranking_once": """
        SELECT nome AS fornecedor, documento AS cnpj,
               CAST(COALESCE(SUM(excesso) FILTER (ordem = 1), 0) AS DECIMAL(38,2))
                   AS saldo_excedente_recebido,
               COUNT(*) FILTER (dia < inicio) AS qtd_pagamentos_antecipados,
               CAST(SUM(pago) AS DECIMAL(38,2)) AS total_recebido_geral
        FROM risco_fornecedor GROUP BY nome, documento""",
    "s02_supplier_exposure": """
        SELECT criterio, lugar, fornecedor, cnpj, saldo_excedente_recebido, qtd_pagamentos_antecipados
        FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY criterio ORDER BY saldo_excedente_recebido DESC NULLS LAST,
                       cnpj ASC NULLS FIRST, fornecedor ASC NULLS FIRST, qtd_pagamentos_antecipados DESC) AS INT) AS lugar
              FROM (SELECT 'RECEBIDO_MENOS_CONTRATOS' AS criterio, f.nome AS fornecedor, f.documento AS cnpj,
                           CAST(SUM(pago) - SUM(DISTINCT teto) AS DECIMAL(38,2)) AS saldo_excedente_recebido,
                           COUNT(*) FILTER (dia < inicio) AS qtd_pagamentos_antecipados
                    FROM ciclo k JOIN fornecedor f ON f.id_fornecedor = k.id_fornecedor
                    GROUP BY f.id_fornecedor, f.nome, f.documento
                    UNION ALL
                    SELECT 'EXCESSO_POR_PAGAMENTO', nome, documento, CAST(SUM(excesso) AS DECIMAL(38,2)),
                           COUNT(*) FILTER (dia < inicio)
                    FROM risco_fornecedor GROUP BY nome, documento
                    UNION ALL
                    SELECT 'EXCESSO_POR_EMPENHO', nome, documento,
                           CAST(COALESCE(SUM(excesso) FILTER (ordem = 1), 0) AS DECIMAL(38,2)),
                           COUNT(*) FILTER (dia < inicio)
                    FROM risco_fornecedor GROUP BY nome, documento))
        WHERE lugar <= 3""",
    "g08_open_overvalued_contracts": """
        SELECT id_contrato, id_empenho, f.nome AS fornecedor, teto AS valor_contrato,
               reservado AS valor_reservado_empenho,
               CAST(reservado - teto AS DECIMAL(18,2)) AS excesso_reservado,
               CAST(SUM(pago) AS DECIMAL(38,2)) AS total_ja_pago,
               'EMPENHO MAIOR QUE CONTRATO (SEM LIQUIDAÇÃO)' AS risco_detectado
        FROM ciclo JOIN fornecedor f USING (id_fornecedor)
        WHERE reservado > teto AND id_empenho NOT IN (FROM liquidados)
        GROUP BY id_contrato, id_empenho, f.nome, teto, reservado""",
    "g09_open_contract_dates": """
        SELECT id_empenho, id_pagamento, dia AS datapagamentoempenho, inicio AS data_inicio_contrato,
               IF(dia < inicio, 'PAGOU_ANTES_DO_CONTRATO', 'PAGOU_DURANTE_VIGENCIA') AS checagem_data,
               pago AS valor_pago
        FROM ciclo WHERE id_empenho NOT IN (FROM liquidados)""",
    "g10_payment_before_commitment": """
        SELECT id_empenho, f.nome AS fornecedor, emissao_empenho AS data_empenho, dia AS data_pagamento,
               CAST(emissao_empenho - dia AS INT) AS dias_inconsistencia, pago AS valor_pago
        FROM precoce LEFT JOIN contrato c USING (id_contrato)
        LEFT JOIN fornecedor f ON f.id_fornecedor = c.id_fornecedor""",
    "g11_budget_execution": """
        SELECT id_empenho, reservado AS valor_empenhado, CAST(SUM(pago) AS DECIMAL(38,2)) AS total_pago,
               CAST(SUM(pago) - reservado AS DECIMAL(38,2)) AS diferenca_estouro,
               'PAGO A MAIOR QUE EMPENHO' AS status_execucao
        FROM emp_pag GROUP BY id_empenho, reservado HAVING SUM(pago) > reservado""",
    "g12_finished_but_early": """
        SELECT id_empenho, id_contrato, f.nome AS fornecedor, dia AS data_pagamento,
               inicio AS data_inicio_contrato, pago AS valor_pago,
               'FINALIZADO (COM DOC) MAS ANTECIPADO' AS status_auditoria
        FROM antecipado JOIN fornecedor f USING (id_fornecedor) WHERE id_empenho IN (FROM liquidados)""",
    "g13_irregular_advances": """
        SELECT id_empenho, id_contrato, f.nome AS fornecedor, pago AS valor_pago, dia AS data_pagamento,
               inicio AS data_inicio_contrato, data_emissao AS data_liquidacao,
               'PAGAMENTO ANTES DO CONTRATO E DA LIQUIDAÇÃO' AS tipo_infracao
        FROM par JOIN fornecedor f USING (id_fornecedor) WHERE dia < inicio AND dia < data_emissao""",
    "g15_supplier_dossier": """
        SELECT nome AS fornecedor, documento AS cnpj,
               CAST(SUM(pago) AS DECIMAL(38,2)) AS total_recebido,
               CAST(SUM(excesso) AS DECIMAL(38,2)) AS saldo_excedente_recebido,
               COUNT(*) FILTER (dia < inicio) AS qtd_pagamentos_antecipados
        FROM risco_fornecedor GROUP BY nome, documento""",
    "c02_unliquidated_detail": """
        SELECT id_empenho, id_pagamento, pago AS valor_pago, dia AS data_pagamento,
               IF(id_pagamento IN (SELECT id FROM nfe_pagamento WHERE chave_nfe IS NOT NULL),
                  'COM_NFE_VINCULADA', 'SEM_NFE_VINCULADA') AS status_fiscal_pagamento
        FROM emp_pag WHERE id_empenho NOT IN (FROM liquidados)""",
    "c13_over_contract_detail": """
        SELECT id_pagamento, f.nome AS fornecedor, id_contrato, teto AS valor_contrato,
               pago AS valor_pago, CAST(pago - teto AS DECIMAL(18,2)) AS valor_excedente,
               IF(dia < inicio, 'Antes da Vigência', 'Durante Vigência') AS momento_pagamento
        FROM acima JOIN fornecedor f USING (id_fornecedor)""",
    "c15_critical_detail": """
        SELECT DISTINCT en.nome AS orgao_pagador, f.nome AS nome_fornecedor, id_empenho,
               teto AS valor_contrato, pago AS valor_pago,
               CAST(pago - teto AS DECIMAL(18,2)) AS valor_excedente,
               'CRITICO: SOBREPREÇO + SEM LIQUIDAÇÃO' AS status_auditoria
        FROM acima JOIN fornecedor f USING (id_fornecedor) JOIN entidade en USING (id_entidade)
        WHERE id_empenho NOT IN (FROM liquidados)""",
    "m01_irregularity_report": "SELECT * FROM irregular",
    "m02_csv_sink": """
        SELECT entidade_responsavel, fornecedor, objeto_contrato, id_empenho,
               CAST(id_contrato AS VARCHAR) AS id_contrato, tipo_irregularidade,
               replace(regexp_replace(CAST(valor_teto_contrato AS VARCHAR), '(\\.\\d)0$', '\\1'), '.', ',')
                   AS valor_teto_contrato,
               replace(regexp_replace(CAST(valor_total_pago AS VARCHAR), '(\\.\\d)0$', '\\1'), '.', ',')
                   AS valor_total_pago,
               replace(regexp_replace(CAST(valor_prejuizo_estimado AS VARCHAR), '(\\.\\d)0$', '\\1'), '.', ',')
                   AS valor_prejuizo_estimado
        FROM irregular""",
    "m03_csv_source": "SELECT * FROM irregular",
    "m04_expense_by_object": """
        SELECT objeto_contrato, CAST(SUM(valor_total_pago) AS DECIMAL(38,2)) AS valor_total_pago,
               CAST(SUM(valor_prejuizo_estimado) AS DECIMAL(38,2)) AS valor_prejuizo_estimado,
               ROUND(100 * (CAST(SUM(valor_total_pago) AS DOUBLE)
                            / (SELECT CAST(SUM(valor_total_pago) AS DOUBLE) FROM irregular)), 2)
                   AS percentual_pago
        FROM irregular WHERE objeto_contrato IS NOT NULL GROUP BY objeto_contrato""",
    "r01_entity_count": "SELECT COUNT(*) AS total_entidades FROM entidade",
    "r02_total_spent_by_entity": """
        SELECT id_entidade, en.nome AS nome_entidade, COUNT(*) AS qtd_pagamentos,
               CAST(SUM(pago) AS DECIMAL(38,2)) AS total_gasto
        FROM ciclo JOIN entidade en USING (id_entidade) GROUP BY id_entidade, en.nome""",
}

# The same results under a second name.
SAME_AS = {
    "g01_detailed_irregularities": "q12_real_excess_paid",
    "g05_payments_without_liquidation": "q04_payments_without_liquidation",
    "g06_over_ceiling_summary": "q24_payment_over_ceiling_summary",
    "g07_critical_cases": "q29_critical_cases",
    "g14_modus_operandi": "q32_modus_operandi",
    "g16_orphan_table": "q35_orphan_invoice_payments",
}


def _repeated(columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tabela, '{c}' AS coluna, CAST({c} AS VARCHAR) AS chave, COUNT(*) AS ocorrencias "
        f"FROM {t} GROUP BY {c} HAVING COUNT(*) > 1 OR {c} IS NULL" for t, c in columns.items())


def _repeated_summary(columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tabela, '{c}' AS coluna, COUNT(*) AS linhas, "
        f"COUNT(*) - COUNT({c}) AS chaves_nulas, "
        f"(SELECT COUNT(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) > 1))"
        f" AS chaves_repetidas, COUNT({c}) - COUNT(DISTINCT {c}) AS linhas_excedentes FROM {t}"
        for t, c in columns.items())


def _not_null() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tabela, COUNT(*) AS linhas, '{c}' AS coluna, COUNT(*) - COUNT({c}) AS nulos FROM {t}"
        for t in COLUMNS for c in required_columns(t))


def _unknown(k: ForeignKey) -> str:
    known = f"SELECT {k.parent_column} FROM {k.parent} WHERE {k.parent_column} IS NOT NULL"
    return f"{k.column} IS NOT NULL AND {k.column} NOT IN ({known})"


def _orphans() -> str:
    return " UNION ALL ".join(
        f"SELECT '{k.name}' AS restricao, CAST({k.column} AS VARCHAR) AS chave, COUNT(*) AS linhas "
        f"FROM {k.table} WHERE {_unknown(k)} GROUP BY {k.column}" for k in FOREIGN_KEYS)


def _orphan_summary() -> str:
    return " UNION ALL ".join(
        f"SELECT '{k.name}' AS restricao, COUNT(*) AS linhas, COUNT(*) - COUNT({k.column}) AS nulas, "
        f"COUNT(*) FILTER ({_unknown(k)}) AS linhas_orfas, "
        f"COUNT(DISTINCT {k.column}) FILTER ({_unknown(k)}) AS chaves_orfas FROM {k.table}"
        for k in FOREIGN_KEYS)


def _domains() -> str:
    parts = []
    for table in COLUMNS:
        for column, limit in TEXT_LENGTHS.get(table, {}).items():
            parts.append(
                f"SELECT '{table}' AS tabela, '{column}' AS coluna, 'varchar({limit})' AS dominio, "
                f"MAX(LENGTH({column})) AS maior_tamanho, "
                f"COUNT(*) FILTER (LENGTH({column}) > {limit}) AS violacoes FROM {table}")
        for column in money_columns(table):
            parts.append(
                f"SELECT '{table}' AS tabela, '{column}' AS coluna, 'numeric(15,2)' AS dominio, "
                f"CAST(NULL AS BIGINT) AS maior_tamanho, "
                f"COUNT(*) FILTER (ABS({column}) > {LARGEST_AMOUNT}) AS violacoes FROM {table}")
    return " UNION ALL ".join(parts)


def _scan() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tabela, COUNT(*) AS linhas, COUNT(*) FILTER ("
        + " AND ".join(f"{c} IS NOT NULL" for c in required_columns(t))
        + f") AS linhas_completas FROM {t}" for t in COLUMNS)


def _document_status(documento: str) -> str:
    def wrong(weights: tuple[int, ...]) -> str:
        rest = "(" + " + ".join(f"{w} * CAST({documento}[{i}] AS INT)" for i, w in enumerate(weights, 1)) + ") % 11"
        return f"CAST({documento}[{len(weights) + 1}] AS INT) <> IF({rest} < 2, 0, 11 - {rest})"

    def broken(size: int, rules: tuple[tuple[int, ...], ...]) -> str:
        tests = [wrong(w) for w in rules] + [f"{documento} = repeat({documento}[1], {size})"]
        return f"LENGTH({documento}) = {size} AND ({' OR '.join(tests)})"

    return f"""CASE WHEN {documento} IS NULL OR NOT regexp_full_match({documento}, '[0-9]+') THEN 'NAO_NUMERICO'
                    WHEN LENGTH({documento}) NOT IN (11, 14) THEN 'TAMANHO_INVALIDO'
                    WHEN {broken(11, CPF_WEIGHTS)} THEN 'DIGITO_VERIFICADOR_INVALIDO'
                    WHEN {broken(14, CNPJ_WEIGHTS)} THEN 'DIGITO_VERIFICADOR_INVALIDO'
                    ELSE 'VALIDO' END"""


def _documents() -> str:
    return f"""
        SELECT id_fornecedor, nome, documento, {_document_status("documento")} AS situacao_documento
        FROM fornecedor"""


def _repaired(source: str) -> str:
    """Documents of ``source`` with their status and the valid ones that an invalid one may stand for."""
    return f"""
        SELECT documento, situacao, list_sort(list(candidato) FILTER (WHERE valido = 'VALIDO' AND situacao <> 'VALIDO')) AS achados
        FROM (
          SELECT documento, situacao, candidato, {_document_status("candidato")} AS valido
          FROM (
            SELECT DISTINCT documento, situacao, unnest(list_concat([so, '0' || so],
                     [so[1 : i - 1] || so[i + 1 : length(so)] for i in range(1, length(so) + 1)])) AS candidato
            FROM (SELECT DISTINCT documento, {_document_status("documento")} AS situacao,
                         regexp_replace(documento, '[^0-9]', '', 'g') AS so
                  FROM ({source}) WHERE documento IS NOT NULL)))
        GROUP BY documento, situacao"""


def _document_repair() -> str:
    return f"""
        SELECT id_fornecedor, nome, f.documento, {_document_status("f.documento")} AS situacao_documento,
               CASE WHEN coalesce(len(achados), 0) = 0 THEN 'SEM_CANDIDATO' WHEN len(achados) = 1 THEN 'CORRIGIDO' ELSE 'AMBIGUO' END
                 AS situacao_correcao,
               CASE WHEN len(achados) = 1 THEN achados[1] END AS documento_corrigido,
               coalesce(array_to_string(achados, ','), '') AS candidatos
        FROM fornecedor f LEFT JOIN ({_repaired("SELECT documento FROM fornecedor")}) r ON r.documento = f.documento
        WHERE {_document_status("f.documento")} <> 'VALIDO'"""


def _divergence_canonical() -> str:
    source = "SELECT documento FROM fornecedor UNION SELECT cnpj_emitente FROM nfe"
    return f"""
        SELECT f.nome AS fornecedor, numero_nfe, valor_total_nfe AS valor_real_da_nota, valor AS valor_lancado_no_sistema,
               CAST(valor_total_nfe - valor AS DECIMAL(18,2)) AS divergencia_fiscal, id_empenho, documento_emitente
        FROM (
          SELECT n.numero_nfe, n.valor_total_nfe, l.valor, l.id_empenho,
                 CASE WHEN len(achados) = 1 THEN achados[1] ELSE cnpj_emitente END AS documento_emitente
          FROM liquidacao_nota_fiscal l JOIN nfe n ON n.chave_nfe = l.chave_danfe
          JOIN empenho e ON e.id_empenho = l.id_empenho
          LEFT JOIN ({_repaired(source)}) r ON r.documento = n.cnpj_emitente
          WHERE l.valor <> n.valor_total_nfe)
        LEFT JOIN (
          SELECT nome, CASE WHEN len(achados) = 1 THEN achados[1] ELSE f.documento END AS meant
          FROM fornecedor f LEFT JOIN ({_repaired(source)}) r ON r.documento = f.documento) f ON meant = documento_emitente"""


def _summary() -> str:
    figures = {
        "empenhos_emitidos": "COUNT(*) FROM empenho",
        "empenhos_com_pagamento": "COUNT(DISTINCT id_empenho) FROM emp_pag",
        "empenhos_sem_pagamento":
            "COUNT(*) FROM empenho WHERE id_empenho NOT IN (SELECT id_empenho FROM pagamento)",
        "empenhos_ciclo_completo":
            "COUNT(DISTINCT id_empenho) FROM emp_pag WHERE id_empenho IN (FROM liquidados)",
        "empenhos_pagos_sem_liquidacao":
            "COUNT(DISTINCT id_empenho) FROM emp_pag WHERE id_empenho NOT IN (FROM liquidados)",
        "empenhos_pagos_a_maior":
            "COUNT(*) FROM empenho e LEFT JOIN pago_por_empenho s USING (id_empenho) WHERE COALESCE(soma, 0) > valor",
        "empenhos_pagos_no_valor":
            "COUNT(*) FROM empenho e LEFT JOIN pago_por_empenho s USING (id_empenho) WHERE COALESCE(soma, 0) = valor",
        "empenhos_pagos_a_menor":
            "COUNT(*) FROM empenho e LEFT JOIN pago_por_empenho s USING (id_empenho) WHERE COALESCE(soma, 0) < valor",
        "pagamentos_antes_do_empenho": "COUNT(*) FROM precoce",
        "pagamentos_antes_do_contrato": "COUNT(*) FROM antecipado",
        "pagamentos_acima_do_contrato": "COUNT(*) FROM acima",
        "pagamentos_acima_do_contrato_antes_da_vigencia": "COUNT(*) FROM acima WHERE dia < inicio",
        "pagamentos_acima_do_contrato_sem_liquidacao":
            "COUNT(*) FROM acima WHERE id_empenho NOT IN (FROM liquidados)",
        "excesso_sobre_contratos": "COALESCE(SUM(pago - teto), 0) FROM acima",
        "contratos_registrados": "COUNT(*) FROM contrato",
        "contratos_sem_empenho":
            "COUNT(*) FROM contrato WHERE id_contrato NOT IN"
            " (SELECT id_contrato FROM empenho WHERE id_contrato IS NOT NULL)",
        "fornecedores_cadastrados": "COUNT(*) FROM fornecedor",
        "pagamentos_sem_liquidacao_sem_nfe":
            "COUNT(*) FROM emp_pag WHERE id_empenho NOT IN (FROM liquidados)"
            " AND id_pagamento NOT IN (SELECT id FROM nfe_pagamento)",
        "pagamentos_antes_da_liquidacao":
            "COUNT(*) FROM precoce k JOIN liquidacao_nota_fiscal l USING (id_empenho) WHERE dia < l.data_emissao",
        "adiantamentos_completos":
            "COUNT(DISTINCT id_empenho) FROM par WHERE dia < inicio AND dia < data_emissao",
        "valor_dos_adiantamentos_completos":
            "COALESCE(SUM(pago), 0) FROM par WHERE dia < inicio AND dia < data_emissao",
        "empenhos_abertos_acima_do_contrato":
            "COUNT(DISTINCT id_empenho) FROM aberto JOIN fornecedor f USING (id_fornecedor)"
            " WHERE reservado > teto",
        "empenhos_abertos_com_excesso_pago":
            "COUNT(*) FROM (SELECT id_empenho FROM aberto JOIN fornecedor f USING (id_fornecedor)"
            " WHERE reservado > teto GROUP BY id_empenho, teto HAVING SUM(pago) > teto)",
        "notas_com_valor_divergente": "COUNT(*) FROM divergente",
        "empenhos_pagos_acima_das_notas": "COUNT(*) FROM acima_das_notas",
        "pagamentos_irregulares_com_nota": "COALESCE(SUM(n), 0) FROM suspeito",
        "volume_irregular_com_nota": "COALESCE(SUM(volume), 0) FROM suspeito",
        "empenhos_problematicos": "COUNT(DISTINCT id_empenho) FROM problema JOIN entidade en USING (id_entidade)",
        "impacto_financeiro_total": "COALESCE(SUM(IF(pago > teto, pago - teto, pago)), 0)"
            " FROM problema JOIN entidade en USING (id_entidade)",
        "registros_de_pagamento_de_nota": "COUNT(*) FROM nfe_pagamento",
        "pagamentos_de_nota_orfaos": "COUNT(*) FROM orfao",
    }

    def row(metric: str, text: str) -> str:
        value, source = text.split(" FROM ", 1)
        return f"SELECT '{metric}' AS metrica, CAST({value} AS DECIMAL(38,2)) AS valor FROM {source}"

    return " UNION ALL ".join(row(m, t) for m, t in figures.items())


def _key_slices(count: int = 16, sample: int = 16384) -> str:
    """A sample of keys by their md5, keys at its regular places, and the rows between these."""
    def of(table: str, key: str) -> str:
        return f"""
        SELECT '{table}' AS tabela, CAST(row_number() OVER (ORDER BY de NULLS FIRST) - 1 AS INT) AS fatia,
               CAST(de AS VARCHAR) AS de, CAST(ate AS VARCHAR) AS ate, linhas
        FROM (
          SELECT de, ate, COUNT(*) FILTER (WHERE k.linha IS NOT NULL) AS linhas
          FROM (
            SELECT de, lead(de) OVER (ORDER BY de NULLS FIRST) AS ate
            FROM (
              SELECT DISTINCT chave AS de
              FROM (
                SELECT {key} AS chave, row_number() OVER (ORDER BY {key}) - 1 AS lugar, COUNT(*) OVER () AS m
                FROM {table}, (SELECT COUNT(*) AS n FROM {table})
                WHERE {key} IS NOT NULL AND (n <= {sample}
                  OR CAST('0x' || md5(CAST({key} AS VARCHAR))[1:8] AS BIGINT) < {sample} * 4294967296 // n)),
                range(1, {count}) AS u(i)
              WHERE lugar = i * m // {count}
              UNION ALL SELECT NULL)) b
          LEFT JOIN (SELECT {key} AS chave, 1 AS linha FROM {table}) k
            ON ((de IS NULL OR chave >= de) AND (ate IS NULL OR chave < ate)) OR (chave IS NULL AND de IS NULL)
          GROUP BY de, ate)"""

    return " UNION ALL ".join(of(t, c) for t, c in PRIMARY_KEYS.items())


def all_sql(definitions: dict[str, str] = DEFINITIONS) -> dict[str, str]:
    """Every check; with ``VIEWS`` as definitions, over audit tables that exist."""
    selects = dict(SELECTS)
    selects |= {name: SELECTS[other] for name, other in SAME_AS.items()}
    selects |= {
        "d01_primary_key_violations": _repeated(PRIMARY_KEYS),
        "d01b_primary_key_summary": _repeated_summary(PRIMARY_KEYS),
        "d02_unique_violations": _repeated(UNIQUE_COLUMNS),
        "d02b_unique_summary": _repeated_summary(UNIQUE_COLUMNS),
        "d03_not_null_violations": _not_null(),
        "d04_foreign_key_orphans": _orphans(),
        "d04b_foreign_key_summary": _orphan_summary(),
        "d05_domain_violations": _domains(),
        "m05_source_scan": _scan(),
        "m06_key_slices": _key_slices(),
        "r03_supplier_document_validity": _documents(),
        "r03b_supplier_document_repair": _document_repair(),
        "q31b_invoice_divergence_canonical": _divergence_canonical(),
        "s01_audit_summary": _summary(),
    }
    return {name: with_definitions(sql, definitions) for name, sql in selects.items()}
