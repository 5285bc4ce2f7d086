"""Independent ANSI-SQL (DuckDB dialect) statements for every registered query.

They run over the driver's pre-registered views (orders, customer, nation, region, events, ...)
and rebuild the fixture views and the cleaning rules in SQL, so the Spark code path is checked
against a separate implementation of the same semantics.
"""

from __future__ import annotations

from .. import constants as K
from ..sources.fixtures import GAZETTE_SQL, INCOMPLETE_STATE, MOV_SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def blank_to(x: str, d: str) -> str:
    return f"coalesce(nullif({strip(x)}, ''), {_q(d)})"


def _origin_case(rep: str, gov: str) -> str:
    whens = " ".join(f"WHEN {rep} = {_q(n)} THEN {_q(o)}" for n, o in K.ORIGEM_POR_NOME.items())
    return (f"CASE WHEN {rep} = {_q(K.NAO_IDENTIFICADO)} THEN {_q(K.NAO_IDENTIFICADO)} {whens} "
            f"WHEN strpos({gov}, {_q(K.ACTING_MARKER)}) > 0 THEN {_q(K.ORIGEM_VICE)} "
            f"ELSE {_q(K.ORIGEM_EXECUTIVO)} END")


def _authorship(cargo: str) -> str:
    c = strip(f"coalesce({cargo}, '')")
    return (f"CASE WHEN regexp_matches({c}, '(?i)^(?:Subsecret.rio|Secret.rio)(?:\\b|\\s+-)') THEN {_q(K.AUTORIA_SECRETARIA)} "
            f"WHEN regexp_matches({c}, '(?i)^Governador(?:\\b|\\s+-)') THEN {_q(K.AUTORIA_GOVERNADOR)} "
            f"ELSE {_q(K.AUTORIA_OUTRO)} END")


_SIGNER_COLS = """
  {autoridade} AS autoridade_assinante, {autoria} AS autoria_ato, g AS governador_edicao,
  rep AS representante_governo, {origem} AS origem_representante,
  rep || ' (' || {origem} || ')' AS representante_origem"""


def _signers() -> str:
    return _SIGNER_COLS.format(autoridade=blank_to("cargo_assinante", K.SEM_IDENTIFICACAO),
                               autoria=_authorship("cargo_assinante"), origem=_origin_case("rep", "g"))


def _with_rep(src: str) -> str:
    g = blank_to("governador_edicao", K.NAO_IDENTIFICADO)
    return (f"(SELECT *, CASE WHEN strpos(g, ' - ') > 0 THEN {blank_to('split_part(g, ' + _q(' - ') + ', 1)', K.NAO_IDENTIFICADO)} "
            f"ELSE g END AS rep FROM (SELECT *, {g} AS g FROM {src}))")


MOV_RAW = MOV_SQL.format(orders="orders", customer="customer", nation="nation", region="region")

BASE_CTES = f"""
mov AS ({MOV_RAW}),
mov_c AS (
  SELECT mov_id, estado, nome_normalizado AS pessoa, tipo_ato, orgao, cargo_assinante,
         data_publicacao AS data_movimentacao, CAST(year(data_publicacao) AS INTEGER) AS ano,
         {_signers()}
  FROM {_with_rep('mov')} m
),
ret0 AS (
  SELECT * FROM (
    SELECT mov_id, estado, nome_normalizado, data_publicacao, tipo_ato, orgao, cargo_assinante, governador_edicao,
           max(CASE WHEN tipo_ato='exoneracao' THEN data_publicacao END) OVER w AS data_exoneracao_anterior,
           lag(orgao) OVER (PARTITION BY nome_normalizado ORDER BY data_publicacao, mov_id) AS orgao_ant
    FROM mov WHERE nome_normalizado IS NOT NULL
    WINDOW w AS (PARTITION BY nome_normalizado ORDER BY data_publicacao, mov_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  ) t WHERE tipo_ato='nomeacao' AND data_exoneracao_anterior IS NOT NULL
),
ret AS (
  SELECT *, date_diff('day', data_exoneracao_anterior, data_publicacao) AS dias_desde_exoneracao,
         CASE WHEN orgao <> orgao_ant THEN 'sim' ELSE 'nao' END AS mudou_orgao_desde_exoneracao,
         CASE mov_id % 3 WHEN 0 THEN 'sim' WHEN 1 THEN 'nao' END AS mudou_cargo_desde_exoneracao
  FROM ret0
),
ret_f AS (
  SELECT *, coalesce(lower({strip('mudou_cargo_desde_exoneracao')}) = 'sim', true) AS mudou_cargo,
            coalesce(lower({strip('mudou_orgao_desde_exoneracao')}) = 'sim', true) AS mudou_orgao,
            CASE WHEN dias_desde_exoneracao IS NULL THEN 'desconhecido' WHEN dias_desde_exoneracao = 0 THEN 'imediato'
                 WHEN dias_desde_exoneracao < 30 THEN 'curto' WHEN dias_desde_exoneracao <= 180 THEN 'medio'
                 ELSE 'longo' END AS tempo_cluster
  FROM {_with_rep('ret')} r
),
ret_c AS (
  SELECT mov_id, estado, nome_normalizado AS pessoa, tipo_ato, orgao, cargo_assinante,
         data_publicacao AS data_nomeacao, data_exoneracao_anterior AS data_exoneracao,
         CAST(year(data_publicacao) AS INTEGER) AS ano, CAST(dias_desde_exoneracao AS INTEGER) AS dias_desde_exoneracao,
         {_signers()},
         mudou_cargo, mudou_orgao, tempo_cluster,
         'N_' || tempo_cluster || '_' || CASE WHEN mudou_cargo THEN 'novo_cargo' ELSE 'mesmo_cargo' END
              || '_' || CASE WHEN mudou_orgao THEN 'novo_orgao' ELSE 'mesmo_orgao' END AS estado_N
  FROM ret_f
)"""


def with_base(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    ctes = BASE_CTES + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def ptbr(x: str) -> str:
    return f"replace(format('{{:,}}', CAST({x} AS BIGINT)), ',', '.')"


# ---- shared SQL fragments ---------------------------------------------------------------------

def _in(values) -> str:
    return "(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def _rep_name(x: str) -> str:
    g = strip(f"coalesce(nullif({x}, ''), {_q(K.NAO_IDENTIFICADO)})")
    head = blank_to(f"split_part({g}, ' - ', 1)", K.NAO_IDENTIFICADO)
    return f"CASE WHEN strpos({g}, ' - ') > 0 THEN {head} ELSE {g} END"


def _first_last(n: str) -> str:
    toks = rf"string_split_regex({strip(n)}, '\s+')"
    return f"CASE WHEN len({toks}) >= 2 THEN {toks}[1] || ' ' || {toks}[-1] ELSE {n} END"


def _gov_short(x: str) -> str:
    g = strip(f"coalesce(nullif({x}, ''), {_q(K.NAO_IDENTIFICADO)})")
    nome = f"split_part({g}, ' - ', 1)"
    cargo = f"substr({g}, strpos({g}, ' - ') + 3)"
    return f"CASE WHEN strpos({g}, ' - ') > 0 THEN {_first_last(nome)} || ' - ' || {cargo} ELSE {g} END"


def _agency_cte(src: str = "mov_c") -> str:
    o = strip("orgao")
    r1 = rf"regexp_replace({o}, '\s+', ' ', 'g')"
    r2 = rf"regexp_replace({r1}, '\s*-\s*', ' - ', 'g')"
    r3 = strip(rf"regexp_replace({r2}, '\s*/\s*', '/', 'g')")
    rot = (f"CASE WHEN {o} IS NULL OR {o} = '' OR lower({o}) IN ('nan', 'none', 'null') THEN '' ELSE {r3} END")
    k1 = rf"regexp_replace(lower(orgao_rotulo), '\s*-\s*', ' ', 'g')"
    k2 = strip(rf"regexp_replace({k1}, '\s+', ' ', 'g')")
    return (f"ag0 AS (SELECT *, {rot} AS orgao_rotulo FROM {src}),\n"
            f"keyed AS (SELECT * FROM (SELECT *, {k2} AS orgao_chave FROM ag0) WHERE orgao_chave <> ''),\n"
            "spell AS (SELECT orgao_chave, orgao_rotulo, count(*) AS n FROM keyed GROUP BY ALL),\n"
            "labels AS (SELECT orgao_chave, orgao_rotulo AS orgao_grafico, CAST(tot AS BIGINT) AS n_atos FROM ("
            "SELECT *, row_number() OVER (PARTITION BY orgao_chave ORDER BY n DESC, orgao_rotulo) AS rn, "
            "sum(n) OVER (PARTITION BY orgao_chave) AS tot FROM spell) WHERE rn = 1)")


def _axis_sql(src: str = "mov_c") -> str:
    return (f"(SELECT CASE WHEN coalesce(bool_and(origem_representante = {_q(K.EIXO_SETOR)}), false) "
            f"THEN {_q(K.EIXO_SETOR)} ELSE {_q(K.EIXO_GOVERNO)} END FROM {src} WHERE origem_representante IS NOT NULL)")


def _signed(q: str) -> str:
    return f"CASE WHEN tipo_ato = {_q(K.EXONERACAO)} THEN -{q} ELSE {q} END"


SETORES = ("setores AS (SELECT * REPLACE (orgao AS representante_origem, "
           f"{_q(K.EIXO_SETOR)} AS origem_representante) FROM mov_c),\n")


def _flow_sql(force: str | None, src: str = "mov_c", first: str = "") -> str:
    axis = _q(force) if force else _axis_sql(src)
    return with_base(
        "SELECT representante_origem, tipo_ato, quantidade, fluxo, rotulo, peso_ordem FROM b "
        f"WHERE {axis} <> {_q(K.EIXO_SETOR)} OR representante_origem IN "
        f"(SELECT representante_origem FROM w ORDER BY peso_ordem DESC, representante_origem DESC LIMIT {K.TOP_N_SETOR})",
        first + f"b0 AS (SELECT representante_origem, tipo_ato, count(*) AS quantidade FROM {src} "
        "WHERE representante_origem IS NOT NULL AND tipo_ato IS NOT NULL GROUP BY ALL),\n"
        f"b AS (SELECT *, {_signed('quantidade')} AS fluxo, {ptbr('quantidade')} AS rotulo, "
        "CAST(sum(quantidade) OVER (PARTITION BY representante_origem) AS BIGINT) AS peso_ordem FROM b0),\n"
        "w AS (SELECT DISTINCT representante_origem, peso_ordem FROM b)")


_COUNTS = ("cnt AS (SELECT representante_origem, count(*) FILTER (WHERE tipo_ato = 'exoneracao') AS exoneracao, "
           "count(*) FILTER (WHERE tipo_ato = 'nomeacao') AS nomeacao FROM mov_c "
           "WHERE representante_origem IS NOT NULL AND tipo_ato IS NOT NULL GROUP BY 1)")


def _balance_sql(force: str | None, src: str = "mov_c", first: str = "") -> str:
    axis = _q(force) if force else _axis_sql(src)
    return with_base(
        f"SELECT representante_origem, exoneracao, nomeacao, saldo, "
        f"CASE WHEN saldo >= 0 THEN {_q(K.MAIS_ENTRADAS)} ELSE {_q(K.MAIS_SAIDAS)} END AS cor, {ptbr('saldo')} AS saldo_txt "
        f"FROM bal WHERE {axis} <> {_q(K.EIXO_SETOR)} OR representante_origem IN "
        f"(SELECT representante_origem FROM bal ORDER BY abs(saldo) DESC, representante_origem DESC LIMIT {K.TOP_N_SETOR})",
        first + _COUNTS.replace("mov_c", src) + ",\nbal AS (SELECT *, nomeacao - exoneracao AS saldo FROM cnt)")


def _ret_events(extra: str = "") -> str:
    return (f"ev AS (SELECT pessoa, data_exoneracao AS data, 'E' AS evento, mov_id, 0 AS ord{extra} FROM ret_c "
            f"UNION ALL SELECT pessoa, data_nomeacao AS data, estado_N AS evento, mov_id, 1 AS ord{extra} FROM ret_c)")


RET_SEQ = (_ret_events() + ",\n"
           "seq AS (SELECT pessoa, data, evento, lead(evento) OVER (PARTITION BY pessoa ORDER BY data, mov_id, ord) "
           "AS prox_evento, mov_id, ord FROM ev WHERE data IS NOT NULL AND pessoa IS NOT NULL),\n"
           "trans AS (SELECT evento, prox_evento, count(*) AS n FROM seq WHERE prox_evento IS NOT NULL GROUP BY ALL)")

EVENT_SEQ = ("seq AS (SELECT user_id AS pessoa, ts AS data, event_type AS evento, "
             "lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prox_evento FROM events "
             "WHERE ts IS NOT NULL AND user_id IS NOT NULL),\n"
             "trans AS (SELECT evento, prox_evento, count(*) AS n FROM seq "
             "WHERE prox_evento IS NOT NULL AND evento IS NOT NULL GROUP BY ALL)")

MATRIX = ("st AS (SELECT evento AS s FROM trans UNION SELECT prox_evento FROM trans),\n"
          "m0 AS (SELECT a.s AS evento, b.s AS prox_evento, CAST(coalesce(t.n, 0) AS BIGINT) AS n FROM st a CROSS JOIN st b "
          "LEFT JOIN trans t ON t.evento = a.s AND t.prox_evento = b.s),\n"
          "m AS (SELECT *, n / CASE WHEN sum(n) OVER (PARTITION BY evento) = 0 THEN 1 "
          "ELSE sum(n) OVER (PARTITION BY evento) END AS p FROM m0)")

STEADY_STEPS = 1500
STEADY = (MATRIX + ",\n"
          "rs AS (SELECT evento, sum(p) AS s FROM m GROUP BY evento),\n"
          "q AS (SELECT m.evento AS i, m.prox_evento AS j, 0.5 * (m.p + CASE WHEN m.evento = m.prox_evento AND rs.s = 0 "
          "THEN 1 ELSE 0 END) + CASE WHEN m.evento = m.prox_evento THEN 0.5 ELSE 0 END AS q FROM m JOIN rs USING (evento)),\n"
          "v(step, s, x) AS (SELECT 0, s, CAST(1 AS DOUBLE) / (SELECT count(*) FROM st) FROM st "
          f"UNION ALL SELECT v.step + 1, q.j, sum(v.x * q.q) FROM v JOIN q ON v.s = q.i WHERE v.step < {STEADY_STEPS} "
          "GROUP BY v.step, q.j)")
STEADY_BODY = (f"SELECT s AS evento, round(x / (SELECT sum(x) FROM v WHERE step = {STEADY_STEPS}), 6) AS prob "
               f"FROM v WHERE step = {STEADY_STEPS}")

_PAPEL = ("CASE WHEN strpos(governador_edicao, ' - ') > 0 "
          "THEN substr(governador_edicao, strpos(governador_edicao, ' - ') + 3) ELSE governador_edicao END")

# squaring form of the same limit (for slowly mixing chains): 30 squarings = 2^30 lazy steps,
# rows renormalised at every step; the working table is joined with itself
STEADY_SQUARE = (MATRIX + ",\n"
                 "rs AS (SELECT evento, sum(p) AS s FROM m GROUP BY evento),\n"
                 "q AS (SELECT m.evento AS i, m.prox_evento AS j, 0.5 * (m.p + CASE WHEN m.evento = m.prox_evento AND rs.s = 0 "
                 "THEN 1 ELSE 0 END) + CASE WHEN m.evento = m.prox_evento THEN 0.5 ELSE 0 END AS q FROM m JOIN rs USING (evento)),\n"
                 "sq(r, i, j, q) AS (SELECT 0, i, j, CAST(q AS DOUBLE) FROM q WHERE q <> 0 "
                 "UNION ALL SELECT a.r + 1, a.i, b.j, sum(a.q * b.q) / sum(sum(a.q * b.q)) OVER (PARTITION BY a.i) "
                 "FROM sq a JOIN sq b ON a.j = b.i WHERE a.r < 30 GROUP BY a.r, a.i, b.j),\n"
                 "lim AS (SELECT j AS s, sum(q) / (SELECT count(*) FROM st) AS x FROM sq WHERE r = 30 GROUP BY j),\n"
                 "pi AS (SELECT st.s, coalesce(lim.x, 0) AS x FROM st LEFT JOIN lim USING (s))")
SQUARE_BODY = "SELECT s AS evento, round(x / (SELECT sum(x) FROM pi), 6) AS prob FROM pi"

REPORT_BODY = (
    "SELECT 'resumo' AS secao, CAST(k AS INTEGER) AS ordem, linha FROM (VALUES "
    "(1, 'RESUMO ANALÍTICO'), (2, ''), (9, ''), (3, (SELECT 'Registros filtrados: ' || " + "replace(format('{:,}', count(*)), ',', '.') FROM ret_c)), "
    "(4, (SELECT 'Pessoas únicas: ' || replace(format('{:,}', count(DISTINCT pessoa)), ',', '.') FROM ret_c)), "
    "(5, (SELECT 'Tempo médio de retorno: ' || printf('%.2f', avg(CAST(dias_desde_exoneracao AS DOUBLE))) || ' dias' FROM ret_c)), "
    "(6, (SELECT 'Mediana do retorno: ' || printf('%.2f', median(CAST(dias_desde_exoneracao AS DOUBLE))) || ' dias' FROM ret_c)), "
    "(7, (SELECT 'Taxa de mudança de cargo: ' || printf('%.2f', avg(CAST(mudou_cargo AS DOUBLE)) * 100) || '%' FROM ret_c)), "
    "(8, (SELECT 'Taxa de mudança de órgão: ' || printf('%.2f', avg(CAST(mudou_orgao AS DOUBLE)) * 100) || '%' FROM ret_c))"
    ") v(k, linha) "
    "UNION ALL SELECT * FROM (VALUES ('transicoes', 1, 'Top transições:'), ('estacionario', 1, ''), "
    "('estacionario', 2, 'Estado estacionário:')) h "
    "UNION ALL SELECT 'transicoes', CAST(row_number() OVER (ORDER BY n DESC, evento, prox_evento) + 1 AS INTEGER), "
    "evento || ' → ' || prox_evento || ': ' || CAST(n AS VARCHAR) FROM (SELECT * FROM trans ORDER BY n DESC, evento, prox_evento LIMIT 10) "
    "UNION ALL SELECT 'estacionario', CAST(row_number() OVER (ORDER BY p DESC, s) + 2 AS INTEGER), s || ': ' || printf('%.4f', p) "
    "FROM (SELECT s, round(x / (SELECT sum(x) FROM pi), 6) AS p FROM pi)")

TOP30 = "top AS (SELECT * FROM trans ORDER BY n DESC, evento, prox_evento LIMIT 30)"


_PHRASE = r"GOVERNADOR\s+EM\s+EXERC(?:\S*CIO|Ã)"


def _roles_sql() -> str:
    """Lines of the windows around each acting phrase, read in order of search (k: phrase, w: window)."""
    names = ", ".join(f"({i}, {_q(n)}, {_q(label)})" for i, (n, label) in enumerate(K.NOMES_ASSINATURA)
                      if "‰" not in n)  # not a letter: no cleaned line can end with that spelling

    def holder(x: str) -> str:
        return "CASE " + " ".join(f"WHEN contains({x}, {_q(n)}) THEN {_q(label)}" for n, label in K.NOMES_CARGO) + " END"

    return rf"""
WITH d AS (SELECT doc_id, upper(text) AS u FROM ({GAZETTE_SQL.format(documents='documents')})),
cuts AS (SELECT doc_id, u, string_split_regex(u, '{_PHRASE}') AS gap, regexp_extract_all(u, '{_PHRASE}') AS hit FROM d),
hits AS (SELECT doc_id, u, k, hit[k] AS phrase,
                CAST(list_sum(list_transform(gap[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:k - 1], lambda h: length(h))), 0) AS BIGINT) AS ahead
         FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS k FROM cuts)),
sides AS (SELECT *, substr(u, 1, ahead) AS head, substr(u, ahead + length(phrase) + 1) AS tail FROM hits),
parts AS (SELECT *, string_split(head, chr(10))[-1] AS opened, string_split(tail, chr(10))[1] AS closed FROM sides),
windows AS (
  SELECT doc_id, k, 1 AS w, opened || phrase || closed AS area FROM parts
  UNION ALL SELECT doc_id, k, 2, right(left(head, length(head) - length(opened)), 300) FROM parts
            WHERE NOT regexp_matches(opened || phrase || closed, '\b(ATOS?|DESPACHOS?|DECRETOS?|EXPEDIENTE)\b')
  UNION ALL SELECT doc_id, k, 3, left(tail, 5000) FROM parts),
lines AS (SELECT doc_id, k, w, p, string_split_regex(area, '[\n\r\x0b\x0c]')[p] AS line
          FROM (SELECT *, unnest(range(1, len(string_split_regex(area, '[\n\r\x0b\x0c]')) + 1)) AS p FROM windows)),
bare AS (SELECT *, regexp_replace(regexp_replace(line, '\bID\s*:?\s*\d+.*$', ''), '\bGOVERNADOR(\s+EM\s+EXERC\S*CIO)?\b', '', 'g') AS rest FROM lines),
read AS (SELECT *, ' ' || trim(regexp_replace(rest, '[^A-ZÀ-Ü]+', ' ', 'g')) AS clean FROM bare),
signed AS (SELECT doc_id, first(label ORDER BY k, w, p, i) AS label
           FROM read JOIN (VALUES {names}) n(i, name, label) ON ends_with(clean, ' ' || name) GROUP BY doc_id),
acting AS (SELECT DISTINCT doc_id FROM hits),
heads AS (SELECT doc_id, replace(left(u, 15000), 'VICE-GOVERNADOR', 'VICE-#') AS pre FROM d),
named AS (SELECT doc_id,
  regexp_replace(regexp_extract(pre, '(?s)GOVERNADOR\s+(.{{3,120}}?)(?:\s+VICE-#|\n|$)', 1), '\s+', ' ', 'g') AS governor,
  regexp_replace(regexp_extract(pre, '(?s)VICE-#\s+(.{{3,120}}?)(?:\s+(?:ÓRG|Ã“RG|GOVERNO DO ESTADO|ATOS DO)|\n|$)', 1), '\s+', ' ', 'g') AS vice
  FROM heads)
SELECT d.doc_id, coalesce(
  coalesce(signed.label, CASE WHEN acting.doc_id IS NOT NULL THEN {holder('vice')} END) || ' - Governador em exercício',
  {holder('governor')} || ' - Governador', {_q(K.NAO_IDENTIFICADO)}) AS governador_edicao
FROM d JOIN named USING (doc_id) LEFT JOIN signed USING (doc_id) LEFT JOIN acting USING (doc_id)"""


ROLES_SQL = _roles_sql()


def oracle_sql(slice_filters, choice_state: str = "", choice_selected=(), few=()) -> dict[str, str]:
    f = slice_filters
    where = (f"estado = {_q(f.estado)} AND ano IN {_in(f.anos)} AND representante_origem IN {_in(f.representantes)} "
             f"AND autoria_ato IN {_in(f.autorias)} AND tipo_ato IN {_in(f.tipos)} AND orgao IN {_in(f.orgaos)}")
    kpi = ("SELECT count(*) AS atos, count(*) FILTER (WHERE autoria_ato = 'Governador') AS atos_governador, "
           "count(*) FILTER (WHERE autoria_ato = 'Secretaria/Subsecretaria') AS atos_secretarias, "
           "count(*) FILTER (WHERE tipo_ato = 'exoneracao') AS exoneracoes, "
           "count(*) FILTER (WHERE tipo_ato = 'nomeacao') AS nomeacoes, "
           "count(*) FILTER (WHERE tipo_ato = 'nomeacao') - count(*) FILTER (WHERE tipo_ato = 'exoneracao') AS saldo, "
           "count(DISTINCT pessoa) AS pessoas FROM mov_c")
    cards = ("atos", "atos_governador", "atos_secretarias", "exoneracoes", "nomeacoes", "saldo", "pessoas")
    with_texts = lambda sql: "SELECT *, " + ", ".join(f"{ptbr(c)} AS {c}_txt" for c in cards) + f" FROM ({sql})"
    choices = " UNION ALL ".join(
        [f"SELECT 'estado' AS filtro, CAST(estado AS VARCHAR) AS valor FROM mov_c"]
        + [f"SELECT '{k}', CAST({k} AS VARCHAR) FROM {t}" for k in ("ano", "orgao", "representante_origem")
           for t in ("mov_c", "ret_c")])
    series_ctes = (
        "base AS (SELECT *, CAST(date_trunc('month', data_movimentacao) AS DATE) AS periodo, "
        f"{strip(_PAPEL)} AS papel "
        "FROM mov_c WHERE data_movimentacao IS NOT NULL AND representante_governo IS NOT NULL AND tipo_ato IS NOT NULL),\n"
        "cnt AS (SELECT periodo, representante_governo, tipo_ato, count(*) AS quantidade FROM base GROUP BY ALL),\n"
        "pf AS (SELECT * FROM (SELECT periodo, representante_governo, tipo_ato, papel, data_movimentacao, mov_id, "
        "row_number() OVER (PARTITION BY periodo, representante_governo, tipo_ato, papel ORDER BY data_movimentacao, mov_id) AS rn "
        "FROM base WHERE papel IS NOT NULL AND papel <> '') WHERE rn = 1),\n"
        "pap AS (SELECT periodo, representante_governo, tipo_ato, string_agg(papel, ' / ' ORDER BY data_movimentacao, mov_id) AS papeis "
        "FROM pf GROUP BY ALL),\n"
        "of AS (SELECT * FROM (SELECT periodo, representante_governo, tipo_ato, origem_representante, data_movimentacao, mov_id, "
        "row_number() OVER (PARTITION BY periodo, representante_governo, tipo_ato, origem_representante ORDER BY data_movimentacao, mov_id) AS rn "
        "FROM base WHERE origem_representante IS NOT NULL AND origem_representante <> '') WHERE rn = 1),\n"
        "ori AS (SELECT periodo, representante_governo, tipo_ato, string_agg(origem_representante, ' / ' ORDER BY data_movimentacao, mov_id) AS origem "
        "FROM of GROUP BY ALL),\n"
        "serie AS (SELECT c.*, coalesce(p.papeis, 'Nao identificado') AS papeis, coalesce(o.origem, 'Nao identificado') AS origem "
        "FROM cnt c LEFT JOIN pap p USING (periodo, representante_governo, tipo_ato) "
        "LEFT JOIN ori o USING (periodo, representante_governo, tipo_ato)),\n"
        "tot AS (SELECT representante_governo, CAST(sum(quantidade) AS BIGINT) AS total_governo, "
        "first(origem ORDER BY tipo_ato, periodo) AS origem_governo FROM serie GROUP BY 1),\n"
        "main AS (SELECT * FROM serie WHERE tipo_ato IN ('nomeacao', 'exoneracao')),\n"
        "spans AS (SELECT representante_governo, tipo_ato, min(periodo) AS lo, max(periodo) AS hi FROM main GROUP BY ALL),\n"
        "cal AS (SELECT representante_governo, tipo_ato, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS periodo FROM spans)")
    series_body = (
        "SELECT cal.periodo, cal.representante_governo, cal.tipo_ato, main.quantidade, "
        "CASE WHEN cal.tipo_ato = 'exoneracao' THEN -main.quantidade ELSE main.quantidade END AS quantidade_sinal, "
        "coalesce(main.papeis, '') AS papeis, coalesce(main.origem, tot.origem_governo) AS origem, "
        f"CASE WHEN {_axis_sql()} = 'Setor' THEN cal.representante_governo "
        f"ELSE {_first_last(_rep_name('cal.representante_governo'))} || ' (' || tot.origem_governo || ')' END AS rotulo_serie, "
        "tot.total_governo, (SELECT max(quantidade) FROM serie) AS max_quantidade "
        "FROM cal LEFT JOIN main USING (periodo, representante_governo, tipo_ato) "
        "LEFT JOIN tot ON tot.representante_governo = cal.representante_governo")
    month_period = ("CASE WHEN date_trunc('month', data_movimentacao) = date_trunc('month', (SELECT m FROM mx)) "
                    "THEN (SELECT m FROM mx) + 1 ELSE last_day(data_movimentacao) END")
    return {
        "clean_movements": with_base("SELECT * FROM mov_c"),
        "classify_returns": with_base("SELECT * FROM ret_c"),
        "filter_slice": with_base(f"SELECT * FROM mov_c WHERE {where}"),
        "filter_choices": with_base(f"SELECT DISTINCT filtro, valor FROM ({choices}) WHERE valor IS NOT NULL"),
        "representative_choices": with_base(
            f"SELECT DISTINCT CAST(representante_origem AS VARCHAR) AS valor, "
            f"CAST(representante_origem AS VARCHAR) IN {_in(choice_selected)} AS selecionado FROM mov_c "
            f"WHERE estado = {_q(choice_state)} AND representante_origem IS NOT NULL"),
        "kpi_cards": with_base(with_texts(kpi)),
        "kpi_cards_slice": with_base(with_texts(kpi + f" WHERE {where}")),
        "slice_reading": with_base(
            f"SELECT *, {ptbr('registros')} AS registros_txt, {ptbr('pessoas')} AS pessoas_txt, "
            "replace(governo_top || format(' ({:,})', governo_top_total), ',', '.') AS governo_top_txt, "
            "replace(orgao_top || format(' ({:,})', orgao_top_total), ',', '.') AS orgao_top_txt FROM ("
            "SELECT CASE WHEN lo IS NULL THEN 'sem periodo' WHEN lo = hi THEN CAST(lo AS VARCHAR) "
            "ELSE CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) END AS periodo, registros, pessoas, "
            "coalesce((SELECT l FROM g), 'Nao identificado') AS governo_top, coalesce((SELECT n FROM g), 0) AS governo_top_total, "
            "coalesce((SELECT l FROM o), 'Nao identificado') AS orgao_top, coalesce((SELECT n FROM o), 0) AS orgao_top_total, "
            "saldo, direcao, " + ptbr("saldo") + " || ' (' || direcao || ')' AS saldo_txt FROM "
            "(SELECT *, CASE WHEN saldo >= 0 THEN 'mais entradas que saidas' ELSE 'mais saidas que entradas' END AS direcao FROM b))",
            "g AS (SELECT representante_origem AS l, count(*) AS n FROM mov_c WHERE representante_origem IS NOT NULL "
            "GROUP BY 1 ORDER BY n DESC, l LIMIT 1),\n"
            f"o AS (SELECT {strip('orgao')} AS l, count(*) AS n FROM mov_c WHERE orgao IS NOT NULL AND {strip('orgao')} <> '' "
            "GROUP BY 1 ORDER BY n DESC, l LIMIT 1),\n"
            "b AS (SELECT min(ano) AS lo, max(ano) AS hi, count(*) AS registros, count(DISTINCT pessoa) AS pessoas, "
            "count(*) FILTER (WHERE tipo_ato = 'nomeacao') - count(*) FILTER (WHERE tipo_ato = 'exoneracao') AS saldo FROM mov_c)"),
        "period_label": with_base(
            "SELECT estado, CASE WHEN count(ano) = 0 THEN 'sem período' WHEN count(ano) = 1 THEN CAST(min(ano) AS VARCHAR) "
            "WHEN max(ano) - min(ano) + 1 = count(ano) THEN CAST(min(ano) AS VARCHAR) || '-' || CAST(max(ano) AS VARCHAR) "
            "ELSE string_agg(CAST(ano AS VARCHAR), ', ' ORDER BY ano) END AS periodo FROM ya GROUP BY estado",
            "ya AS (SELECT DISTINCT estado, ano FROM mov_c)"),
        "acts_by_year": with_base("SELECT ano, tipo_ato, count(*) AS quantidade FROM mov_c "
                                  "WHERE ano IS NOT NULL AND tipo_ato IS NOT NULL GROUP BY ALL"),
        "acts_by_month": with_base("SELECT CAST(date_trunc('month', data_movimentacao) AS DATE) AS mes, tipo_ato, "
                                   "count(*) AS quantidade FROM mov_c WHERE data_movimentacao IS NOT NULL "
                                   "AND tipo_ato IS NOT NULL GROUP BY ALL"),
        "agency_labels": with_base("SELECT * FROM labels", _agency_cte()),
        "agency_flow_top10": with_base(
            "SELECT b.orgao_chave, l.orgao_grafico, b.tipo_ato, b.quantidade, "
            f"{_signed('b.quantidade')} AS fluxo, {ptbr('b.quantidade')} AS rotulo, "
            "CAST(sum(b.quantidade) OVER (PARTITION BY l.orgao_grafico) AS BIGINT) AS peso_ordem, rk.ranking "
            "FROM bars b JOIN tl l USING (orgao_chave) JOIN rk USING (orgao_chave)",
            _agency_cte() + ",\n"
            "rk AS (SELECT orgao_chave, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, orgao_chave) AS INTEGER) "
            "AS ranking FROM keyed GROUP BY 1 ORDER BY n DESC, orgao_chave LIMIT 10),\n"
            "tl AS (SELECT * FROM labels WHERE orgao_chave IN (SELECT orgao_chave FROM rk)),\n"
            "bars AS (SELECT orgao_chave, tipo_ato, count(*) AS quantidade FROM keyed "
            "WHERE orgao_chave IN (SELECT orgao_chave FROM rk) AND tipo_ato IS NOT NULL GROUP BY ALL)"),
        "government_flow": _flow_sql(None),
        "government_flow_dense": with_base(
            "SELECT r.representante_origem, t.tipo_ato, CAST(coalesce(c.quantidade, 0) AS BIGINT) AS quantidade, "
            "CASE WHEN t.tipo_ato = 'exoneracao' THEN -coalesce(c.quantidade, 0) ELSE coalesce(c.quantidade, 0) END AS fluxo "
            "FROM r CROSS JOIN t LEFT JOIN c USING (representante_origem, tipo_ato)",
            "f AS (SELECT * FROM mov_c WHERE representante_origem IS NOT NULL AND tipo_ato IS NOT NULL),\n"
            "r AS (SELECT DISTINCT representante_origem FROM f), t AS (SELECT DISTINCT tipo_ato FROM f),\n"
            "c AS (SELECT representante_origem, tipo_ato, count(*) AS quantidade FROM f GROUP BY ALL)"),
        "government_balance": _balance_sql(None),
        "sector_flow_top10": _flow_sql(K.EIXO_SETOR),
        "sector_flow_auto": _flow_sql(None, "setores", SETORES),
        "sector_balance_auto": _balance_sql(None, "setores", SETORES),
        "document_roles": ROLES_SQL,
        "scan_states": with_base(
            "SELECT 'movimentacoes' AS tabela, estado, pessoa, tipo_ato, orgao, autoridade_assinante, ano, representante_origem, "
            "data_movimentacao AS data, CAST(NULL AS DATE) AS data_exoneracao, CAST(NULL AS INTEGER) AS dias_desde_exoneracao, "
            f"CAST(NULL AS VARCHAR) AS \"estado_N\" FROM mov_c WHERE estado <> {_q(INCOMPLETE_STATE)} UNION ALL "
            "SELECT 'retornos', estado, pessoa, tipo_ato, nullif(orgao, ''), autoridade_assinante, ano, representante_origem, "
            f"data_nomeacao, data_exoneracao, dias_desde_exoneracao, \"estado_N\" FROM ret_c WHERE estado <> {_q(INCOMPLETE_STATE)}"),
        "government_timeline_few": with_base(
            f"SELECT {month_period} AS periodo, representante_origem, tipo_ato, count(*) AS quantidade FROM few "
            "WHERE data_movimentacao IS NOT NULL AND tipo_ato IS NOT NULL GROUP BY ALL",
            f"few AS (SELECT * FROM mov_c WHERE representante_origem IN {_in(few)}),\n"
            "mx AS (SELECT max(data_movimentacao) AS m FROM few)"),
        "sector_balance_top10": _balance_sql(K.EIXO_SETOR),
        "government_summary": with_base("SELECT representante_origem, exoneracao, nomeacao, nomeacao - exoneracao AS saldo, "
                                        "nomeacao + exoneracao AS atos FROM cnt", _COUNTS),
        "government_timeline_year": with_base(
            "SELECT CAST(year(data_movimentacao) AS INTEGER) AS periodo, representante_origem, tipo_ato, count(*) AS quantidade "
            "FROM mov_c WHERE data_movimentacao IS NOT NULL AND representante_origem IS NOT NULL AND tipo_ato IS NOT NULL GROUP BY ALL"),
        "government_timeline_month": with_base(
            f"SELECT {month_period} AS periodo, representante_origem, tipo_ato, count(*) AS quantidade FROM mov_c "
            "WHERE data_movimentacao IS NOT NULL AND representante_origem IS NOT NULL AND tipo_ato IS NOT NULL GROUP BY ALL",
            "mx AS (SELECT max(data_movimentacao) AS m FROM mov_c WHERE data_movimentacao IS NOT NULL)"),
        "government_series": with_base(series_body, series_ctes),
        "returns_timeline": with_base("SELECT ano, tempo_cluster, count(*) AS eventos FROM ret_c "
                                      "WHERE ano IS NOT NULL AND tempo_cluster IS NOT NULL GROUP BY ALL"),
        "mobility_timeline": with_base(
            "SELECT ano, count(pessoa) AS total, CAST(sum(CAST(mudou_cargo AS BIGINT)) AS BIGINT) AS mudou_cargo, "
            "CAST(sum(CAST(mudou_orgao AS BIGINT)) AS BIGINT) AS mudou_orgao, "
            "round(sum(CAST(mudou_cargo AS BIGINT)) / count(pessoa), 9) AS tx_mudou_cargo, "
            "round(sum(CAST(mudou_orgao AS BIGINT)) / count(pessoa), 9) AS tx_mudou_orgao "
            "FROM ret_c WHERE ano IS NOT NULL GROUP BY ano"),
        "returns_summary": with_base(
            "SELECT count(*) AS registros, count(DISTINCT pessoa) AS pessoas, "
            "round(avg(CAST(dias_desde_exoneracao AS DOUBLE)), 9) AS media_dias, "
            "round(median(CAST(dias_desde_exoneracao AS DOUBLE)), 9) AS mediana_dias, "
            "round(avg(CAST(mudou_cargo AS DOUBLE)), 9) AS tx_mudou_cargo, "
            "round(avg(CAST(mudou_orgao AS DOUBLE)), 9) AS tx_mudou_orgao FROM ret_c"),
        "event_sequence": with_base("SELECT pessoa, data, evento, prox_evento, mov_id, ord FROM seq", RET_SEQ),
        "transitions": with_base("SELECT * FROM trans", RET_SEQ),
        "event_transitions": with_base("SELECT * FROM trans", EVENT_SEQ),
        "transitions_top30": with_base(
            "SELECT evento, prox_evento, n, CAST(row_number() OVER (ORDER BY n DESC, evento, prox_evento) AS INTEGER) AS rank "
            "FROM trans QUALIFY rank <= 30", RET_SEQ),
        "transitions_by_year_top30": with_base(
            "SELECT y.*, a.idx AS source, b.idx AS target FROM y JOIN lab a ON a.s = y.evento JOIN lab b ON b.s = y.prox_evento",
            _ret_events(", ano") + ",\n"
            "seq AS (SELECT ano, evento, lead(evento) OVER (PARTITION BY ano, pessoa ORDER BY data, mov_id, ord) AS prox_evento "
            "FROM ev WHERE data IS NOT NULL AND pessoa IS NOT NULL AND ano IS NOT NULL),\n"
            "t AS (SELECT ano, evento, prox_evento, count(*) AS n FROM seq WHERE prox_evento IS NOT NULL GROUP BY ALL),\n"
            "y AS (SELECT ano, evento, prox_evento, n, CAST(row_number() OVER (PARTITION BY ano ORDER BY n DESC, evento, prox_evento) "
            "AS INTEGER) AS rank FROM t QUALIFY rank <= 30),\n"
            "lab AS (SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS idx FROM "
            "(SELECT evento AS s FROM y UNION SELECT prox_evento FROM y))"),
        "transition_matrix": with_base("SELECT evento, prox_evento, n, round(p, 9) AS p, printf('%.2f', p) AS p_txt FROM m",
                                       RET_SEQ + ",\n" + MATRIX),
        "event_transition_matrix": with_base("SELECT evento, prox_evento, n, round(p, 9) AS p, printf('%.2f', p) AS p_txt FROM m",
                                             EVENT_SEQ + ",\n" + MATRIX),
        "steady_state": with_base(STEADY_BODY, EVENT_SEQ + ",\n" + STEADY, recursive=True),
        "returns_steady_state": with_base(SQUARE_BODY, RET_SEQ + ",\n" + STEADY_SQUARE, recursive=True),
        "returns_report": with_base(REPORT_BODY, RET_SEQ + ",\n" + STEADY_SQUARE, recursive=True),
        "sankey_edges": with_base(
            "SELECT t.evento, t.prox_evento, t.n, a.idx AS source, b.idx AS target FROM top t "
            "JOIN lab a ON a.s = t.evento JOIN lab b ON b.s = t.prox_evento",
            RET_SEQ + ",\n" + TOP30 + ",\n"
            "lab AS (SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS idx FROM "
            "(SELECT evento AS s FROM top UNION SELECT prox_evento FROM top))"),
        "node_degree": with_base(
            "SELECT no, count(*) AS grau, 8 + 4 * count(*) AS tamanho FROM "
            "(SELECT evento AS no FROM top UNION ALL SELECT prox_evento FROM top) GROUP BY no",
            RET_SEQ + ",\n" + TOP30),
        "short_labels": with_base(
            f"SELECT DISTINCT governador_edicao, representante_governo, "
            f"{_first_last(_rep_name('representante_governo'))} AS rotulo_curto, "
            f"{_gov_short('governador_edicao')} AS rotulo_governo_curto FROM mov_c"),
    }
