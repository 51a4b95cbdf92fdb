"""The registered ledger queries, each over its whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import documents as D
from ledgerloom.functions import fields as X
from ledgerloom.operators import consolidate, export, greedy, ingest, ledger, registry, sheet
from ledgerloom.operators.storage import written
from ledgerloom.plans.views import view, with_views
from ledgerloom.sources import ofx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, views: str, sql: str | None = None) -> Callable:
    """Registers a function of views (in the order named) under a name, with its SQL."""
    names = views.split()

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in names])
        if sql:
            SQL[name] = with_views(*names) + sql if names else sql
        return f

    return keep


IS_APPROVED = "status IN ('CONFIRMADO', 'EXPORTADO') AND NOT deletado AND canonica_id IS NULL"
MASKED = "substr(documento, 1, 3) || '.' || substr(documento, 4, 3) || '.' || substr(documento, 7, 3) || '-' || substr(documento, 10, 2)"

query("approved_list", "movimentacao pessoa prestador", f"""
SELECT m.id, data_movimento, valor, direcao, status, m.cnpj_prestador, coalesce(nome_estadual, nome_municipal) AS prestador_nome, {MASKED} AS documento, nome AS pessoa_nome, confianca
FROM (SELECT * FROM movimentacao WHERE {IS_APPROVED} AND uf = 1 AND exercicio = 1996 ORDER BY data_movimento DESC, cnpj_prestador, id LIMIT 50) m
LEFT JOIN prestador p ON m.cnpj_prestador = p.cnpj_prestador LEFT JOIN pessoa q ON q.tipo = 'PF' AND m.pessoa_id = q.pessoa_id""")(
    lambda m, p, r: ledger.approved_list(m, p, r, uf=1, exercicio=1996)
)
query("approved_resumo", "movimentacao", f"""
SELECT uf, exercicio, count(*) AS total, count(*) FILTER (WHERE status = 'CONFIRMADO') AS confirmado, count(*) FILTER (WHERE status = 'EXPORTADO') AS exportado
FROM movimentacao WHERE {IS_APPROVED} GROUP BY uf, exercicio""")(lambda m: ledger.approved_summary(m, "uf", "exercicio"))
query("approved_prestadores", "movimentacao prestador", f"""
SELECT DISTINCT m.cnpj_prestador, coalesce(nome_estadual, nome_municipal) AS prestador_nome FROM movimentacao m LEFT JOIN prestador p ON m.cnpj_prestador = p.cnpj_prestador WHERE {IS_APPROVED}""")(ledger.approved_prestadores)
query("status_counts", "movimentacao", "SELECT status, count(*) AS n FROM movimentacao GROUP BY status")(ledger.status_counts)
query("status_counts_scoped", "movimentacao", """
SELECT status, uf, exercicio, count(*) AS n, CAST(grouping(uf) AS INT) AS is_global FROM movimentacao GROUP BY GROUPING SETS ((status), (status, uf, exercicio))""")(lambda m: ledger.status_counts(m, scoped=True))
query("confidence_buckets", "movimentacao", """
SELECT count(*) FILTER (WHERE confianca < 0.6) AS baixa, count(*) FILTER (WHERE confianca >= 0.6 AND confianca < 0.85) AS media, count(*) FILTER (WHERE confianca >= 0.85) AS alta
FROM movimentacao WHERE NOT deletado""")(ledger.confidence_buckets)
query("system_stats", "movimentacao", """
SELECT count(*) AS total, count(*) FILTER (WHERE deletado) AS deletadas, count(*) FILTER (WHERE canonica_id IS NOT NULL) AS absorvidas,
  count(*) FILTER (WHERE bloqueio_export AND NOT deletado) AS bloqueadas, count(*) FILTER (WHERE pessoa_id IS NULL) AS sem_pessoa FROM movimentacao""")(ledger.system_stats)
query("export_guard", "movimentacao", """
SELECT cnpj_prestador, exercicio, count(*) FILTER (WHERE status NOT IN ('CONFIRMADO', 'EXPORTADO') OR bloqueio_export) AS bloqueios,
  count(*) FILTER (WHERE status NOT IN ('CONFIRMADO', 'EXPORTADO') OR bloqueio_export) = 0 AS exportavel FROM movimentacao GROUP BY cnpj_prestador, exercicio""")(ledger.export_guard)
query("period_by_session", "movimentacao", "SELECT sessao_id, min(data_movimento) AS inicio, max(data_movimento) AS fim, count(*) AS n FROM movimentacao WHERE NOT deletado GROUP BY sessao_id")(ledger.period_by_session)
GAPS = "concat_ws(';', CASE WHEN coalesce(fonte_recurso, '') = '' THEN 'fonte_recurso' END, CASE WHEN coalesce(natureza_recurso, '') = '' THEN 'natureza_recurso' END, CASE WHEN coalesce(tipo_origem_recurso, '') = '' THEN 'tipo_origem_recurso' END)"
query("pending_report", "movimentacao classificacao", f"""
SELECT id, data_movimento AS data, valor, descricao_raw AS descricao, coalesce(nullif(concat_ws('; ', CASE WHEN status NOT IN ('CONFIRMADO', 'EXPORTADO') THEN 'status=' || status END,
  CASE WHEN bloqueio_export AND {GAPS} <> '' THEN 'campos_xsd_obrigatorios_faltantes' WHEN bloqueio_export THEN 'bloqueio_export' END, CASE WHEN confianca < 0.6 THEN 'confianca_baixa' END), ''), 'pendencia') AS motivo,
  {GAPS} AS campos_xsd_faltantes, arquivo_id AS arquivo_origem
FROM movimentacao LEFT JOIN classificacao ON id = movimentacao_id WHERE status NOT IN ('CONFIRMADO', 'EXPORTADO') OR bloqueio_export""")(ledger.pending_report)
query("person_search", "pessoa movimentacao", """
SELECT p.tipo, p.pessoa_id, documento, nome, coalesce(n, 0) AS movimentacoes, ufs FROM pessoa p
LEFT JOIN (SELECT pessoa_id, count(*) AS n, string_agg(DISTINCT CAST(uf AS VARCHAR), ', ' ORDER BY CAST(uf AS VARCHAR)) AS ufs FROM movimentacao WHERE pessoa_id IS NOT NULL GROUP BY pessoa_id) u
ON p.tipo = 'PF' AND p.pessoa_id = u.pessoa_id WHERE nome ILIKE '%00012%' OR documento LIKE '%00012%'""")(lambda p, m: registry.search(p, m, "00012"))
query("person_counts", "movimentacao", "SELECT pessoa_id, uf, exercicio, count(*) AS n FROM movimentacao WHERE pessoa_id IS NOT NULL GROUP BY pessoa_id, uf, exercicio")(registry.counts)
SCORES = """SELECT movimentacao_id, round(least(1.0, sum(CASE WHEN tipo LIKE 'CONFLITO%' THEN 0 ELSE coalesce(peso, CASE tipo WHEN 'CPF_EXATO' THEN 0.45 WHEN 'VALOR_DATA' THEN 0.25 WHEN 'NOME_FUZZY' THEN 0.1 ELSE 0 END) END),
  CASE WHEN bool_or(tipo LIKE 'CONFLITO%') THEN 0.4 ELSE 1.0 END), 6) AS confianca FROM evidencia GROUP BY movimentacao_id"""
query("evidence_score", "evidencia", SCORES)(ledger.evidence_scores)
query("confirm_partition", "movimentacao classificacao evidencia", f"""
SELECT q.id, resultado, CASE WHEN resultado = 'confirmado' THEN coalesce(s.confianca, CAST(0 AS DOUBLE)) END AS confianca FROM (
SELECT i.id, CASE WHEN m.id IS NULL THEN 'nao_encontrado' WHEN {GAPS} <> '' THEN 'bloqueado' ELSE 'confirmado' END AS resultado
FROM (SELECT id FROM movimentacao UNION ALL SELECT -id FROM movimentacao) i LEFT JOIN (SELECT id FROM movimentacao WHERE NOT deletado) m ON i.id = m.id LEFT JOIN classificacao c ON i.id = c.movimentacao_id) q
LEFT JOIN ({SCORES}) s ON q.id = s.movimentacao_id""")(lambda m, c, e: ledger.confirm(m.select(F.explode(F.array("id", -F.col("id"))).alias("id")), m, c, e))
query("status_transition", "movimentacao", """
SELECT id, CASE WHEN status <> 'PENDENTE_REVISAO' OR bloqueio_export THEN status ELSE 'CONFIRMADO' END AS status_novo,
  CASE WHEN status <> 'PENDENTE_REVISAO' THEN 'transicao' WHEN bloqueio_export THEN 'bloqueio' END AS erro FROM movimentacao""")(lambda m: ledger.change_status(m, "CONFIRMADO"))
HASH = "sha256(CAST(cnpj_prestador AS VARCHAR) || '|' || CAST(exercicio AS VARCHAR) || '|' || CAST(data_movimento AS VARCHAR) || '|' || CAST(valor AS VARCHAR) || '|' || descricao_raw || '|' || direcao || '|||')"
query("hash_key", "movimentacao", f"SELECT id, {HASH} AS hash FROM movimentacao")(lambda m: m.select("id", ingest.row_hash(m.columns).alias("hash")))


def _dedup(lines: DataFrame) -> DataFrame:
    parsed = lines.select("id", F.col("sessao_id").alias("cnpj_prestador"), F.year("data_movimento").alias("exercicio"), F.last_day("data_movimento").alias("data_movimento"), (F.floor(F.col("valor") / 10) * 10).cast("decimal(15,2)").alias("valor"), F.col("papel").alias("descricao_raw"), "direcao")
    hashed = parsed.withColumn("hash", ingest.row_hash(parsed.columns))
    live = hashed.where("id % 3 = 1").select("hash", (F.col("id") % 7 == 0).alias("deletado"))
    return ingest.new_rows(parsed, live).select("id", "cnpj_prestador", "hash")


query("dedup_live", "linha", f"""
, p AS (SELECT id, sessao_id AS cnpj_prestador, CAST(year(data_movimento) AS INT) AS exercicio, last_day(data_movimento) AS data_movimento, CAST(floor(valor / 10) * 10 AS DECIMAL(15,2)) AS valor, papel AS descricao_raw, direcao FROM linha),
h AS (SELECT *, {HASH} AS hash FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY cnpj_prestador, exercicio, hash ORDER BY id) AS k FROM h)
SELECT id, cnpj_prestador, hash FROM f WHERE k = 1 AND hash NOT IN (SELECT hash FROM h WHERE id % 3 = 1 AND id % 7 <> 0)""")(_dedup)
query("mask_document", "pessoa", f"""
SELECT tipo, pessoa_id, CASE WHEN tipo = 'PF' THEN {MASKED} ELSE substr(documento, 1, 2) || '.' || substr(documento, 3, 3) || '.' || substr(documento, 6, 3) || '/' || substr(documento, 9, 4) || '-' || substr(documento, 13, 2) END AS documento
FROM pessoa""")(lambda p: p.select("tipo", "pessoa_id", D.mask_document(F.col("documento")).alias("documento")))
_DV1 = " + ".join(f"CAST(substr(documento, {k}, 1) AS INT) * {11 - k}" for k in range(1, 10))
_DV2 = " + ".join(f"CAST(substr(documento, {k}, 1) AS INT) * {12 - k}" for k in range(1, 11))
query("cpf_check", "pessoa", f"""
SELECT pessoa_id, documento NOT IN ({', '.join(repr(str(d) * 11) for d in range(10))}) AND CASE WHEN ({_DV1}) % 11 < 2 THEN 0 ELSE 11 - ({_DV1}) % 11 END = CAST(substr(documento, 10, 1) AS INT)
  AND CASE WHEN ({_DV2}) % 11 < 2 THEN 0 ELSE 11 - ({_DV2}) % 11 END = CAST(substr(documento, 11, 1) AS INT) AS valido FROM pessoa WHERE tipo = 'PF'""")(
    lambda p: p.where("tipo = 'PF'").select("pessoa_id", D.cpf_is_valid(F.col("documento")).alias("valido"))
)
query("name_normalise", "pessoa", "SELECT tipo, pessoa_id, upper(strip_accents(trim(regexp_replace(nome, '\\s+', ' ', 'g')))) AS nome FROM pessoa")(lambda p: p.select("tipo", "pessoa_id", D.normalize_name(F.col("nome")).alias("nome")))
query("file_role", "pessoa", """
SELECT tipo, pessoa_id, CASE WHEN pessoa_id % 3 = 0 THEN 'PIX' WHEN pessoa_id % 3 = 1 THEN 'COMPLETO' ELSE 'OUTRO' END AS papel FROM pessoa""")(
    lambda p: p.select("tipo", "pessoa_id", X.file_role(F.concat(F.lit("extrato "), F.when(F.col("pessoa_id") % 3 == 0, "Pix").when(F.col("pessoa_id") % 3 == 1, "TOTAL").otherwise("abril"))).alias("papel"))
)
query("month_filter", "movimentacao", f"SELECT id, data_movimento FROM movimentacao WHERE {IS_APPROVED} AND data_movimento BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")(lambda m: ledger.approved(m, month="1996-02").select("id", "data_movimento"))

PAIRS = """
, a AS (SELECT * FROM linha), x AS (SELECT p.id AS p_id, c.id AS c_id, p.data_movimento AS p_d, c.data_movimento AS c_d, p.valor, p.direcao FROM a p JOIN a c ON p.papel = 'PIX' AND c.papel = 'COMPLETO' AND p.valor = c.valor AND p.direcao = c.direcao
  AND c.data_movimento BETWEEN p.data_movimento AND p.data_movimento + 3 AND p.arquivo_id <> c.arquivo_id AND coalesce(p.conta_id = c.conta_id, true)),
par AS (SELECT CASE WHEN p_d < c_d OR (p_d = c_d AND p_id <= c_id) THEN p_id ELSE c_id END AS a_id, CASE WHEN p_d < c_d OR (p_d = c_d AND p_id <= c_id) THEN c_id ELSE p_id END AS b_id, valor, direcao, CAST(c_d - p_d AS INT) AS dias FROM x
UNION ALL SELECT u.id, v.id, u.valor, u.direcao, 0 FROM a u JOIN a v ON u.valor = v.valor AND u.direcao = v.direcao AND u.data_movimento = v.data_movimento AND u.id < v.id AND u.papel = v.papel AND u.arquivo_id <> v.arquivo_id AND coalesce(u.conta_id = v.conta_id, true))
"""
query("pair_join", "linha", PAIRS + "SELECT a_id, b_id, valor, direcao, dias FROM par")(
    lambda lines: consolidate.candidate_pairs(written(lines, "lines")).select("a_id", "b_id", "valor", "direcao", F.date_diff("b_data_movimento", "a_data_movimento").alias("dias"))
)
# Names of the view agree exactly if one holds the other: none has initials or tokens in another order.
AGREE = "length({0}) > 3 AND length({1}) > 3 AND (contains({0}, {1}) OR contains({1}, {0}))"
LINKED = f"""
, gente AS (SELECT tipo, pessoa_id, documento, upper(nome) AS nome FROM pessoa), nomes AS (SELECT DISTINCT upper(nome) AS n FROM linha WHERE nome IS NOT NULL),
unicos AS (SELECT n, count(*) AS quantos, min(tipo || ':' || CAST(pessoa_id AS VARCHAR)) AS quem FROM nomes JOIN gente ON {AGREE.format("n", "nome")} GROUP BY n),
ligada AS (SELECT l.id, l.papel, l.data_movimento, l.cpf, l.cnpj, upper(l.nome) AS nome, CAST(substr(l.hora, 1, 2) AS INT) * 60 + CAST(substr(l.hora, 4, 2) AS INT) AS minutos,
  CAST(substr(l.nr_documento, 1, 2) AS INT) AS dia, CAST(substr(l.nr_documento, 3, 2) AS INT) * 60 + CAST(substr(l.nr_documento, 5, 2) AS INT) AS dia_minutos,
  f.nome AS pf_nome, 'PF:' || CAST(f.pessoa_id AS VARCHAR) AS pf, j.nome AS pj_nome, 'PJ:' || CAST(j.pessoa_id AS VARCHAR) AS pj, CASE WHEN quantos = 1 THEN quem END AS unico, coalesce(quantos, 0) AS quantos, quem
  FROM linha l LEFT JOIN gente f ON f.tipo = 'PF' AND l.cpf = f.documento LEFT JOIN gente j ON j.tipo = 'PJ' AND l.cnpj = j.documento LEFT JOIN unicos ON upper(l.nome) = n)
"""
SCORED = PAIRS + LINKED + f""", lado AS (SELECT a.id AS a_id, b.id AS b_id, coalesce(a.cpf = b.cpf, false) AS mesmo_cpf, coalesce(a.cnpj = b.cnpj, false) AS mesmo_cnpj, a.nome AS an, b.nome AS bn, b.pf AS b_pf, b.pj AS b_pj, a.unico AS au, b.unico AS bu,
  CASE WHEN a.papel = 'PIX' THEN a.unico ELSE b.unico END AS pu, CASE WHEN b.cpf IS NOT NULL THEN b.pf ELSE a.pf END AS pf, CASE WHEN b.cpf IS NOT NULL THEN b.pf_nome ELSE a.pf_nome END AS pfn,
  CASE WHEN b.cnpj IS NOT NULL THEN b.pj ELSE a.pj END AS pj, CASE WHEN b.cnpj IS NOT NULL THEN b.pj_nome ELSE a.pj_nome END AS pjn, coalesce(abs(a.minutos - b.minutos) > 60, false) AS longe,
  coalesce(a.papel = 'PIX' AND b.papel = 'COMPLETO' AND b.dia = day(a.data_movimento) AND abs(b.dia_minutos - a.minutos) <= 5, false)
    OR coalesce(b.papel = 'PIX' AND a.papel = 'COMPLETO' AND a.dia = day(b.data_movimento) AND abs(a.dia_minutos - b.minutos) <= 5, false) AS na_hora
  FROM par JOIN ligada a ON a.id = a_id JOIN ligada b ON b.id = b_id),
regras AS (SELECT *, coalesce({AGREE.format("an", "bn")}, false) AS nomes, coalesce({AGREE.format("an", "pfn")}, false) OR coalesce({AGREE.format("bn", "pfn")}, false) AS no_pf,
  coalesce({AGREE.format("an", "pjn")}, false) OR coalesce({AGREE.format("bn", "pjn")}, false) AS no_pj FROM lado),
ditas AS (SELECT *, CASE WHEN mesmo_cpf THEN 'MESMO_CPF' WHEN mesmo_cnpj THEN 'MESMO_CNPJ' WHEN na_hora THEN 'DOCUMENTO_HORA' WHEN pf IS NOT NULL AND (nomes OR no_pf) THEN 'CPF_CADASTRO'
  WHEN pj IS NOT NULL AND (nomes OR no_pj) THEN 'CNPJ_CADASTRO' WHEN nomes THEN 'NOME' ELSE 'VALOR_DATA' END AS regra FROM regras),
pontos AS (SELECT *, CASE regra WHEN 'MESMO_CPF' THEN b_pf WHEN 'MESMO_CNPJ' THEN b_pj WHEN 'DOCUMENTO_HORA' THEN coalesce(pf, pj, pu) WHEN 'CPF_CADASTRO' THEN pf WHEN 'CNPJ_CADASTRO' THEN pj WHEN 'NOME' THEN coalesce(pf, pj, au, bu) END AS pessoa FROM ditas),
scored AS (SELECT a_id, b_id, regra, pessoa, longe OR regra = 'VALOR_DATA' AS fraco, mesmo_cpf OR mesmo_cnpj OR na_hora OR nomes AS elegivel,
  CAST(CASE WHEN regra LIKE 'MESMO%' THEN 0.95 WHEN regra = 'DOCUMENTO_HORA' THEN CASE WHEN pessoa IS NULL THEN 0.75 ELSE 0.85 END WHEN regra LIKE '%CADASTRO' THEN 0.9 WHEN regra = 'NOME' THEN CASE WHEN pessoa IS NULL THEN 0.65 ELSE 0.8 END ELSE 0.55 END AS DOUBLE) AS confianca FROM pontos)
"""
PERSON = "concat_ws(':', pessoa.tipo, pessoa.id) AS pessoa"


def _scored(lines: DataFrame) -> DataFrame:
    return consolidate.score_pairs(consolidate.candidate_pairs(lines))


def _ready(lines: DataFrame, people: DataFrame) -> DataFrame:
    """Linked lines, written once: a pair join reads them several times."""
    return written(consolidate.linked(lines, people), "linked")


query("pair_score", "linha pessoa", SCORED + "SELECT a_id, b_id, confianca, regra, coalesce(pessoa, '') AS pessoa, fraco, elegivel FROM scored")(
    lambda lines, people: _scored(_ready(lines, people)).selectExpr("a_id", "b_id", "confianca", "regra", PERSON, "fraco", "elegivel")
)
query("pair_hypotheses", "linha pessoa", SCORED + "SELECT a_id AS id, b_id AS outra_id, CAST(0.55 AS DOUBLE) AS confianca FROM scored WHERE fraco UNION ALL SELECT b_id, a_id, CAST(0.55 AS DOUBLE) FROM scored WHERE fraco")(
    lambda lines, people: consolidate.weak_pairs(_scored(_ready(lines, people)))
)
_COMPARED = "CASE WHEN length(coalesce(nome, '')) <= 3 THEN 'indefinido' WHEN " + AGREE.format("nome", "{0}_nome") + " THEN 'bate' ELSE 'difere' END"
# A line in five with a CPF has a CNPJ too.
query("registry_link", "linha pessoa", LINKED + f""", doc AS (SELECT *, CASE WHEN cpf IS NOT NULL AND id % 5 = 0 THEN '00000000000001' ELSE cnpj END AS outro, CASE WHEN cpf IS NOT NULL THEN {_COMPARED.format("pf")} WHEN cnpj IS NOT NULL THEN {_COMPARED.format("pj")} END AS c FROM ligada)
SELECT id, CASE WHEN cpf IS NOT NULL AND outro IS NOT NULL THEN 'REJEITADO' WHEN coalesce(pf, pj) IS NOT NULL THEN CASE WHEN c = 'bate' THEN 'ALTA' ELSE 'MEDIA' END WHEN c IS NOT NULL OR quantos = 0 THEN 'BAIXA' WHEN quantos = 1 THEN 'MEDIA' ELSE 'REJEITADO' END AS tier,
  CASE WHEN cpf IS NOT NULL AND outro IS NOT NULL THEN 'indefinido' WHEN coalesce(pf, pj) IS NOT NULL THEN c WHEN c IS NULL AND quantos = 1 THEN 'bate' ELSE 'indefinido' END AS comparacao,
  CASE WHEN cpf IS NOT NULL AND outro IS NOT NULL THEN 'CONFLITO_DOCUMENTO' WHEN c IS NOT NULL THEN CASE WHEN cpf IS NOT NULL THEN 'CPF' ELSE 'CNPJ' END || CASE WHEN coalesce(pf, pj) IS NULL THEN '_SEM_CADASTRO' WHEN c = 'difere' THEN '_CADASTRO,NOME_DIVERGE_CADASTRO' ELSE '_CADASTRO' END
    WHEN quantos = 1 THEN 'NOME_CADASTRO' WHEN quantos > 1 THEN 'CONFLITO_NOME' ELSE '' END AS evidencias,
  CAST(CASE WHEN cpf IS NOT NULL AND outro IS NOT NULL THEN 0 WHEN coalesce(pf, pj) IS NOT NULL THEN 0.45 WHEN c IS NULL AND quantos = 1 THEN 0.3825 ELSE 0 END AS DOUBLE) AS peso,
  CASE WHEN cpf IS NOT NULL AND outro IS NOT NULL THEN '' WHEN c IS NOT NULL THEN coalesce(pf, pj, '') WHEN quantos = 1 THEN quem ELSE '' END AS pessoa FROM doc""")(
    lambda lines, people: registry.link(consolidate.linked(lines.withColumn("cnpj", F.when(F.col("cpf").isNotNull() & (F.col("id") % 5 == 0), "00000000000001").otherwise(F.col("cnpj"))), people)).selectExpr("id", "tier", "comparacao", "evidencias", "peso", PERSON)
)
query("pair_greedy", "linha pessoa")(lambda lines, people: greedy.assign_lines(consolidate.linked(lines, people)).select("a_id", "b_id", "confianca"))


@query("singles", "linha pessoa")
def _singles(lines: DataFrame, people: DataFrame) -> DataFrame:
    known = _ready(lines, people)
    # Pairs are made and scored once, to count each line's weak ones; none is kept.
    return consolidate.singles(known, greedy.assign_lines(known), _scored(known))


query("date_gap_explain", "linha", PAIRS + f""", d AS (SELECT u.data_movimento AS p, v.data_movimento AS c FROM par JOIN linha u ON a_id = u.id JOIN linha v ON b_id = v.id),
e AS (SELECT p, c, (SELECT bool_or(dayofweek(x) IN (0, 6)) FROM (SELECT unnest(generate_series(p, c, INTERVAL 1 DAY)) AS x)) AS w,
  (SELECT min(CASE strftime(x, '%m-%d') {' '.join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(X.HOLIDAYS))} END) FROM (SELECT unnest(generate_series(p, c, INTERVAL 1 DAY)) AS x)) AS h FROM (SELECT DISTINCT p, c FROM d))
SELECT p AS pix, c AS completo, CASE WHEN p = c THEN NULL WHEN w THEN 'fim de semana' WHEN h IS NOT NULL THEN 'feriado: ' || CASE h {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(X.HOLIDAYS.values()))} END ELSE 'compensação' END AS motivo,
  CASE WHEN p = c THEN 'ok' ELSE 'info' END AS situacao FROM e""")(
    lambda lines: consolidate.candidate_pairs(written(lines, "lines")).select(F.col("a_data_movimento").alias("pix"), F.col("b_data_movimento").alias("completo")).distinct().select("pix", "completo", *[c.alias(n) for c, n in zip(X.date_gap_reason(F.col("pix"), F.col("completo")), ("motivo", "situacao"))])
)
CAPPED = "CASE WHEN count(*) OVER (PARTITION BY data_movimento, valor, direcao) > 1 AND NOT (pessoa_id IS NOT NULL AND confianca >= 0.9) THEN least(confianca, 0.64) ELSE confianca END"
EVENTS = ", e AS (SELECT id, data_movimento, CAST(floor(valor / 50000) * 50000 AS DECIMAL(15,2)) AS valor, direcao, pessoa_id, confianca, id % 3 <> 0 AS tem_documento FROM movimentacao WHERE NOT deletado)\n"


def _events(m: DataFrame) -> DataFrame:
    return m.where("NOT deletado").select("id", "data_movimento", (F.floor(F.col("valor") / 50000) * 50000).cast("decimal(15,2)").alias("valor"), "direcao", "pessoa_id", "confianca", (F.col("id") % 3 != 0).alias("tem_documento"))


query("same_value_cap", "movimentacao", EVENTS + f"SELECT id, count(*) OVER (PARTITION BY data_movimento, valor, direcao) AS n_mesmo_valor, CAST({CAPPED} AS DOUBLE) AS confianca FROM e")(lambda m: consolidate.cap_same_value(_events(m)).select("id", "n_mesmo_valor", "confianca"))
query("auto_approvable", "movimentacao", EVENTS + f""", c AS (SELECT id, pessoa_id, CAST({CAPPED} AS DOUBLE) AS confianca, CASE WHEN confianca >= 0.9 AND pessoa_id IS NOT NULL AND tem_documento THEN 'ALTA' WHEN confianca >= 0.8 THEN 'MEDIA' ELSE 'BAIXA' END AS tier FROM e)
SELECT id, confianca, tier, pessoa_id IS NOT NULL AND confianca >= 0.85 AND tier = 'ALTA' AS auto FROM c""")(lambda m: consolidate.auto_approvable(_events(m)))
query("canonical_pick", "linha", """
SELECT sessao_id, coalesce(min(CASE WHEN papel = 'COMPLETO' THEN id END), min(id)) AS canonica_id, count(*) AS n_linhas FROM linha GROUP BY sessao_id""")(lambda lines: consolidate.canonical(lines, "sessao_id"))
query("dual_consensus", "linha", """
, r AS (SELECT id, papel, data_movimento, valor, direcao, row_number() OVER (PARTITION BY papel, data_movimento, valor, direcao ORDER BY id) AS k FROM linha)
SELECT coalesce(a.data_movimento, b.data_movimento) AS data_movimento, coalesce(a.valor, b.valor) AS valor, coalesce(a.direcao, b.direcao) AS direcao, a.id AS id_a, b.id AS id_b, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'aceita' ELSE 'incerta' END AS situacao
FROM (SELECT * FROM r WHERE papel = 'PIX') a FULL JOIN (SELECT * FROM r WHERE papel = 'COMPLETO') b ON a.data_movimento = b.data_movimento AND a.valor = b.valor AND a.direcao = b.direcao AND a.k = b.k""")(
    lambda lines: ingest.consensus(lines.where("papel = 'PIX'"), lines.where("papel = 'COMPLETO'"), ["data_movimento", "valor", "direcao"])
)
query("conflict_analysis", "movimentacao", """
SELECT id, CASE WHEN bloqueio_export THEN 'bloqueado' WHEN pessoa_id IS NULL OR confianca < 0.6 THEN 'revisar' ELSE 'pronto' END AS situacao,
  concat_ws(',', CASE WHEN pessoa_id IS NULL THEN 'sem_pessoa' END, CASE WHEN bloqueio_export THEN 'bloqueio' END, CASE WHEN confianca < 0.6 THEN 'baixa_confianca' END) AS achados,
  CAST(pessoa_id IS NULL AS INT) + CAST(bloqueio_export AS INT) + CAST(confianca < 0.6 AS INT) AS n_achados FROM movimentacao""")(sheet.conflicts)
query("reject_anti", "movimentacao", "SELECT id, canonica_id FROM movimentacao m WHERE canonica_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM movimentacao v WHERE v.id = m.canonica_id AND NOT v.deletado AND v.canonica_id IS NULL)")(sheet.rejected_off_sheet)
query("balance_check", "movimentacao", """
, t AS (SELECT sessao_id, sum(CASE WHEN direcao = 'ENTRADA' THEN valor ELSE 0 END) AS c, sum(CASE WHEN direcao = 'SAIDA' THEN valor ELSE 0 END) AS d FROM movimentacao WHERE NOT deletado GROUP BY sessao_id)
SELECT sessao_id, CAST(c AS DECIMAL(18,2)) AS creditos, CAST(d AS DECIMAL(18,2)) AS debitos, sessao_id % 4 <> 0 AS consistente FROM t""")(
    # A session in four has a closing balance that is one unit off.
    lambda m: ingest.balance_check(
        live := m.where("NOT deletado"),
        live.groupBy("sessao_id").agg(F.lit(100).cast("decimal(15,2)").alias("saldo_inicial"), (100 + F.sum(F.when(F.col("direcao") == "ENTRADA", F.col("valor")).otherwise(-F.col("valor"))) + F.when(F.col("sessao_id") % 4 == 0, 1).otherwise(0)).alias("saldo_final")),
        "sessao_id",
    )
)
query("registry_upsert", "pessoa", """
, k AS (SELECT documento, CASE WHEN pessoa_id % 5 = 0 THEN '?' ELSE upper(nome) END AS was, pessoa_id % 7 = 0 AS deletado FROM pessoa WHERE tipo = 'PF' AND pessoa_id % 3 <> 0),
n AS (SELECT documento, nome, 1 AS ordem FROM pessoa WHERE tipo = 'PF' UNION ALL SELECT documento, nome || ' X', 2 FROM pessoa WHERE tipo = 'PF' AND pessoa_id % 2 = 0)
SELECT n.documento, n.nome, n.ordem, CASE WHEN ordem = 2 THEN 'conflito' WHEN k.documento IS NULL THEN 'insere' WHEN deletado THEN 'restaura' WHEN was = '?' THEN 'renomeia' ELSE 'igual' END AS acao
FROM n LEFT JOIN k ON n.documento = k.documento""")(
    lambda p: registry.classify_upserts(
        p.where("tipo = 'PF' AND pessoa_id % 3 <> 0").select("documento", F.when(F.col("pessoa_id") % 5 == 0, "?").otherwise(F.col("nome")).alias("nome"), (F.col("pessoa_id") % 7 == 0).alias("deletado")),
        (f := p.where("tipo = 'PF'")).select("documento", "nome", F.lit(1).alias("ordem")).union(f.where("pessoa_id % 2 = 0").select("documento", F.concat("nome", F.lit(" X")), F.lit(2))),
    )
)
query("prestador_lookup", "prestador", "SELECT cnpj_prestador, coalesce(nome_estadual, nome_municipal) AS prestador_nome FROM prestador")(lambda p: p.select("cnpj_prestador", ledger.prestador_name().alias("prestador_nome")))
query("mirror_fanout", "movimentacao classificacao", """
, j AS (SELECT id, valor, direcao, coalesce(nr_recibo_doacao, '') AS r FROM movimentacao LEFT JOIN classificacao ON id = movimentacao_id)
SELECT id, valor, CASE WHEN direcao = 'ENTRADA' THEN 'origem' ELSE 'aplicacao' END AS documento FROM j UNION ALL SELECT id, valor, 'doacao' FROM j WHERE direcao = 'ENTRADA' AND r <> ''""")(export.fan_out)
query("origin_xml", "movimentacao classificacao pessoa", """
SELECT m.id, m.cnpj_prestador, m.exercicio, m.data_movimento, '<origem>' || CASE WHEN coalesce(fonte_recurso, '') <> '' THEN '<fonteRecurso>' || fonte_recurso || '</fonteRecurso>' ELSE '' END || '<dataMovimento>' || CAST(data_movimento AS VARCHAR) || '</dataMovimento><valor>' || CAST(valor AS VARCHAR) || '</valor>' ||
  coalesce('<nrRecibo>' || nr_recibo_doacao || '</nrRecibo>', '') || coalesce('<cpf>' || documento || '</cpf><nome>' || nome || '</nome>', '') || '<resumo>' || descricao_raw || '</resumo></origem>' AS xml
FROM movimentacao m JOIN classificacao c ON m.id = c.movimentacao_id LEFT JOIN pessoa p ON p.tipo = 'PF' AND m.pessoa_id = p.pessoa_id WHERE direcao = 'ENTRADA' AND status = 'CONFIRMADO'""")(export.origin_items)


def _table(name: str, table: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if sql:
        SQL[name] = sql


_table("json_fields", "events", lambda e: e.select("event_id", X.field(F.from_json("props", "map<string,string>"), "k", F.col("event_type")).alias("k")), "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.k'), ''), event_type) AS k FROM events")
_table("field_union", "events", lambda e: ingest.field_union(e.select(F.from_json("props", "map<string,string>").alias("m")), "m"), "SELECT campo, CAST(row_number() OVER (ORDER BY campo) AS INT) AS posicao FROM (SELECT DISTINCT unnest(json_keys(props)) AS campo FROM events)")
_table("doc_in_text", "documents", lambda d: d.select("doc_id", F.array_join(D.documents_in_text(F.coalesce("text", F.lit(""))), ",").alias("documentos")))
_table("ofx_parse", "orders", lambda o: ofx.parse(o.select(F.col("o_orderkey").cast("string").alias("path"), F.concat(F.lit("<OFX>\n<STMTTRN>\n<TRNAMT>"), F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("\n<DTPOSTED>"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000\n<FITID>"), F.col("o_orderkey").cast("string"), F.lit("\n<MEMO>"), F.col("o_orderpriority"), F.lit("\n</STMTTRN>")).alias("value"))), """
SELECT CAST(o_orderkey AS VARCHAR) AS arquivo, 1 AS posicao, CAST(o_orderdate AS DATE) AS data_movimento, CAST(o_totalprice AS DECIMAL(15,2)) AS valor, CASE WHEN o_orderkey % 3 = 0 THEN 'SAIDA' ELSE 'ENTRADA' END AS direcao, o_orderpriority AS descricao_raw, CAST(o_orderkey AS VARCHAR) AS nr_extrato_bancario FROM orders""")


from ledgerloom.plans import approvals, changes, extracted, opinions, sheets, workbooks  # noqa: E402, F401 - they register their queries with query() above


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
