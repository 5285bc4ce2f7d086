"""Fixed values that must equal the analysed application's for identical answers.

They are stated once, here, in their natural order.
"""

# ---- fixed values: labels -------------------------------------------------------------------
NAO_IDENTIFICADO = "Nao identificado"
SEM_IDENTIFICACAO = "Sem identificação"
AUTORIA_SECRETARIA = "Secretaria/Subsecretaria"
AUTORIA_GOVERNADOR = "Governador"
AUTORIA_OUTRO = "Outro/Nao identificado"
NOMEACAO = "nomeacao"
EXONERACAO = "exoneracao"
EVENTO_EXONERACAO = "E"
ORIGEM_VICE = "Vice-governadoria"
ORIGEM_EXECUTIVO = "Executivo estadual"
ACTING_MARKER = "Governador em exerc"
EIXO_SETOR = "Setor"
EIXO_GOVERNO = "Governo"
MAIS_ENTRADAS = "Mais entradas"
MAIS_SAIDAS = "Mais saídas"
DIRECAO_ENTRADAS = "mais entradas que saidas"
DIRECAO_SAIDAS = "mais saidas que entradas"
SEM_PERIODO = "sem período"
SEM_PERIODO_RESUMO = "sem periodo"
TITULO_RESUMO = "RESUMO ANALÍTICO"
TITULO_TRANSICOES = "Top transições:"
TITULO_ESTACIONARIO = "Estado estacionário:"
NAO_CALCULAVEL = "Não calculável para o filtro atual."
SEM_DADOS = "Sem dados para os filtros selecionados."

# ---- fixed values: sizes and thresholds ------------------------------------------------------
TOP_N_TRANSICOES = 30
TOP_N_ORGAOS = 10
TOP_N_SETOR = 10
TOP_N_RESUMO = 10
ADAPTIVE_MONTH_MAX_GROUPS = 3
TEMPO_CURTO_LT = 30
TEMPO_MEDIO_LE = 180

# ---- fixed values: representative name -> origin ---------------------------------------------
ORIGEM_POR_NOME = {
    "Andre Ceciliano": "ALERJ",
    "Claudio Bomfim de Castro e Silva": "Executivo estadual",
    "Francisco Dornelles": "Vice-governadoria",
    "Luiz Fernando de Souza": "Executivo estadual",
    "Paulo Melo": "ALERJ",
    "Rodrigo Bacellar": "ALERJ",
    "Ricardo Couto de Castro": "TJ-RJ",
    "Sergio Cabral": "Executivo estadual",
    "Thiago Pampolha": "Vice-governadoria",
    "Wilson Jose Witzel": "Executivo estadual",
}

# ---- fixed values: signatures searched near an acting-governor phrase (needle, label) -------
NOMES_ASSINATURA = [
    ("LUIZ FERNANDO DE SOUZA", "Luiz Fernando de Souza"),
    ("SERGIO CABRAL", "Sergio Cabral"),
    ("SÉRGIO CABRAL", "Sergio Cabral"),
    ("SÃ‰RGIO CABRAL", "Sergio Cabral"),
    ("RICARDO COUTO", "Ricardo Couto de Castro"),
    ("THIAGO PAMPOLHA", "Thiago Pampolha"),
    ("THIA GO P AM PO LHA", "Thiago Pampolha"),
    ("RODRIGO BACELLAR", "Rodrigo Bacellar"),
    ("CLÁUDIO BOMFIM DE CASTRO E SILVA", "Cláudio Bomfim de Castro e Silva"),
    ("CLAUDIO BOMFIM DE CASTRO E SILVA", "Cláudio Bomfim de Castro e Silva"),
    ("CLÁUDIO CASTRO", "Cláudio Bomfim de Castro e Silva"),
    ("CLAUDIO CASTRO", "Cláudio Bomfim de Castro e Silva"),
]

# ---- fixed values: names looked up inside a role match (needle, label), first hit wins -------
NOMES_CARGO = [
    ("LUIZ FERNANDO DE SOUZA", "Luiz Fernando de Souza"),
    ("SERGIO CABRAL", "Sergio Cabral"),
    ("SÉRGIO CABRAL", "Sergio Cabral"),
    ("SÃ‰RGIO CABRAL", "Sergio Cabral"),
    ("WILSON JOS", "Wilson Jose Witzel"),
    ("CLÁUDIO BOMFIM DE CASTRO E SILVA", "Cláudio Bomfim de Castro e Silva"),
    ("CLAUDIO BOMFIM DE CASTRO E SILVA", "Cláudio Bomfim de Castro e Silva"),
    ("CLÃ¡UDIO BOMFIM DE CASTRO E SILVA".upper(), "Cláudio Bomfim de Castro e Silva"),
    ("THIAGO PAMPOLHA", "Thiago Pampolha"),
    ("RICARDO COUTO", "Ricardo Couto de Castro"),
    ("RODRIGO BACELLAR", "Rodrigo Bacellar"),
]

# ---- fixed values: agency spellings treated as missing --------------------------------------
ORGAO_NULOS = ("nan", "none", "null")

# ---- fixed values: input file names and column lists -----------------------------------------
ARQUIVO_RETORNOS = "retornos_apos_exoneracao.csv"
ARQUIVO_MOVIMENTACOES = "movimentacoes_pessoas.parquet"
COLUNAS_RETORNO = [
    "nome_normalizado",
    "data_publicacao",
    "data_exoneracao_anterior",
    "orgao",
    "cargo_assinante",
    "governador_edicao",
    "mudou_cargo_desde_exoneracao",
    "mudou_orgao_desde_exoneracao",
    "dias_desde_exoneracao",
]
COLUNAS_MOVIMENTACAO = [
    "nome_normalizado",
    "data_publicacao",
    "tipo_ato",
    "orgao",
    "cargo_assinante",
    "governador_edicao",
]
# pandas CSV reader sentinels that read as missing
CSV_NULOS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
