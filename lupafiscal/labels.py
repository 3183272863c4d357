"""The words the audit's lists use for classes and findings."""

# Invoice payment linked to a payment without liquidation
WITH_INVOICE = "COM_NFE_VINCULADA"
WITHOUT_INVOICE = "SEM_NFE_VINCULADA"

# Fiscal integrity of liquidated payments
INTEGRITY_COMPLETE = "CONCLUÍDO COM NF-E"
INTEGRITY_PENDING = "PENDENTE DE VINCULAÇÃO FISCAL (SEM NF-E NO PAGAMENTO)"

# Contract without commitment
NO_COMMITMENT = "SEM_EMPENHO"

# Commitment against contract
COMMITMENT_ABOVE = "EMPENHO_SUPERIOR_AO_CONTRATO"
COMMITMENT_BELOW = "EMPENHO_INFERIOR_AO_CONTRATO"
COMMITMENT_EQUAL = "EMPENHO_IGUAL_AO_CONTRATO"

# Open payment against the contract's start
OPEN_BEFORE_CONTRACT = "PAGOU_ANTES_DO_CONTRATO"
OPEN_DURING_TERM = "PAGOU_DURANTE_VIGENCIA"

# Early payment against liquidation
PAID_BEFORE_DELIVERY = "PAGOU_ANTES_DE_LIQUIDAR (GRAVÍSSIMO)"
DELIVERED_BEFORE_PAYMENT = "LIQUIDOU_ANTES_MAS_EMPENHOU_DEPOIS (ERRO_CONTABIL)"
NEVER_DELIVERED = "SEM_LIQUIDACAO"

# Commitment against the sum of its payments
OVERPAID = "PAGO_A_MAIOR"
PAID_EXACTLY = "DEVIDAMENTE_PAGO"
NOT_PAID_IN_FULL = "NAO_DEVIDAMENTE_PAGO"

# Finished payment against the contract's start
FINISHED_BEFORE_TERM = "PAGAMENTO_ANTES_DA_VIGENCIA"
FINISHED_ON_START = "PAGAMENTO_NO_INICIO_DA_VIGENCIA"
FINISHED_DURING_TERM = "PAGAMENTO_DURANTE_VIGENCIA"

# Payment against contract and commitment
OVER_CONTRACT = "PAGAMENTO_MAIOR_QUE_CONTRATO"
OVER_COMMITMENT = "PAGAMENTO_MAIOR_QUE_EMPENHO"
WITHIN_LIMIT = "PAGAMENTO_DENTRO_DO_LIMITE"

# Over-contract payment against the contract's start, and in its detailed list
BEFORE_TERM = "ANTES_DA_VIGENCIA"
ON_START = "NO_INICIO_DA_VIGENCIA"
DURING_TERM = "DURANTE_A_VIGENCIA"
LIST_BEFORE_TERM = "Antes da Vigência"
LIST_DURING_TERM = "Durante Vigência"

# Over-contract payment and liquidation
LIQUIDATED = "COM_LIQUIDACAO"
NOT_LIQUIDATED = "SEM_LIQUIDACAO"

# Risk category of a commitment, and kind of irregularity of a payment
RISK_OVERPRICE = "Sobrepreço Contratual"
RISK_NO_DELIVERY = "Pagamento Sem Liquidação"
RISK_OTHER = "Outra Irregularidade"
KIND_OVERPRICE = "Sobrepreço (Acima do Contrato)"
KIND_NO_DELIVERY = "Pagamento Sem Liquidação (Fantasma)"

# Constant findings of single lists
FINDING_EARLY = "PAGAMENTO ANTECIPADO (Antes da vigência)"
FINDING_FINISHED_EARLY = "FINALIZADO (COM DOC) MAS ANTECIPADO"
FINDING_FULL_ADVANCE = "PAGAMENTO ANTES DO CONTRATO E DA LIQUIDAÇÃO"
FINDING_OPEN_OVERVALUED = "EMPENHO MAIOR QUE CONTRATO (SEM LIQUIDAÇÃO)"
FINDING_OVER_COMMITMENT = "PAGO A MAIOR QUE EMPENHO"
FINDING_CRITICAL = "CRITICO: SOBREPREÇO + SEM LIQUIDAÇÃO"
FINDING_ORPHAN = "REGISTRO ORFÃO (SEM LIQUIDAÇÃO VINCULADA)"

# What is done about an invalid supplier document
DOCUMENT_REPAIRED = "CORRIGIDO"
DOCUMENT_AMBIGUOUS = "AMBIGUO"
DOCUMENT_UNKNOWN = "SEM_CANDIDATO"

# How a supplier's excess is reckoned
EXPOSURE_NET = "RECEBIDO_MENOS_CONTRATOS"
EXPOSURE_PER_PAYMENT = "EXCESSO_POR_PAGAMENTO"
EXPOSURE_ONCE = "EXCESSO_POR_EMPENHO"
