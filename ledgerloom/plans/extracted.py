"""Registered queries over extracted items, registry cells, changes and exports, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import cells as C
from ledgerloom.operators import columns, export, extraction, incremental, ledger, locate, mutations, validation
from ledgerloom.operators.storage import fresh_path, written
from ledgerloom.plans.registered import query

CODE = r"regexp_full_match(trim(coalesce(descricao, '')), '[A-Z0-9][A-Z0-9\s.\-/]{2,14}')"
NUMBER = "regexp_replace(coalesce(cpf_cnpj, ''), '[^0-9]', '', 'g')"
ITEMS = f"""
, n AS (SELECT * REPLACE (
  CASE WHEN trim(coalesce(remetente_destinatario, '')) <> '' THEN remetente_destinatario WHEN trim(coalesce(contraparte, '')) <> '' THEN trim(contraparte)
    WHEN length(trim(coalesce(descricao, ''))) >= 8 AND NOT {CODE} THEN trim(descricao) ELSE remetente_destinatario END AS remetente_destinatario,
  CASE WHEN trim(coalesce(cred_dev, '')) <> '' AND lower(trim(cred_dev)) <> 'null' THEN trim(cred_dev) WHEN {CODE} THEN trim(descricao) ELSE cred_dev END AS cred_dev,
  CASE WHEN coalesce(cpf, '') = '' AND length({NUMBER}) = 11 THEN {NUMBER} ELSE cpf END AS cpf,
  CASE WHEN NOT (coalesce(cpf, '') = '' AND length({NUMBER}) = 11) AND coalesce(cnpj, '') = '' AND length({NUMBER}) = 14 THEN {NUMBER} ELSE cnpj END AS cnpj) FROM item)"""
query("item_normalise", "item", ITEMS + "SELECT id, remetente_destinatario, cred_dev, cpf, cnpj FROM n")(
    lambda i: extraction.normalised(i).select("id", "remetente_destinatario", "cred_dev", "cpf", "cnpj")
)
# The fixture's one good CPF and one CNPJ stand for the check digits, which cpf_check tests.
_DIGITS = "regexp_replace(coalesce({0}, ''), '[^0-9]', '', 'g')"
_AMOUNT = r"TRY_CAST(nullif(regexp_extract(replace(regexp_replace(trim(valor), '[\s.]', '', 'g'), ',', '.'), '^[+-]?[0-9]+(\.[0-9]+)?'), '') AS DECIMAL(15,2))"
ROWS = ITEMS + f""", d AS (SELECT *, {_DIGITS.format("cpf")} AS d1, {_DIGITS.format("cnpj")} AS d2, {_DIGITS.format("cpf_cnpj")} AS d3, {_AMOUNT} AS v, upper(trim(direcao)) AS w, trim(coalesce(nome, '')) AS nm, trim(coalesce(descricao, '')) AS ds, trim(coalesce(remetente_destinatario, '')) AS rd FROM n),
e AS (SELECT *, CASE WHEN d1 = '52998224725' THEN 'CPF 52998224725' WHEN length(d2) = 14 THEN 'CNPJ ' || d2 WHEN d3 = '52998224725' THEN 'CPF 52998224725' WHEN length(d3) = 14 THEN 'CNPJ ' || d3 END AS rotulo, v IS NOT NULL AND w IN ('ENTRADA', 'SAIDA') AS util FROM d),
r AS (SELECT *, CASE WHEN rotulo IS NULL AND (length(rd) < 3 OR NOT util) THEN 'ignorada' WHEN util AND regexp_full_match(data, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'linha' ELSE 'erro' END AS estado,
  CASE WHEN rotulo IS NULL THEN coalesce(nullif(ds, ''), rd) WHEN ds <> '' AND nm <> '' AND contains(upper(ds), upper(nm)) THEN ds || ' ' || rotulo ELSE concat_ws(' ', nullif(ds, ''), nullif(nm, ''), rotulo) END AS raw FROM e)
"""
query("item_rows", "item", ROWS + """SELECT id, estado AS situacao, CASE WHEN estado = 'linha' THEN CAST(data AS DATE) END AS data_movimento, CASE WHEN estado = 'linha' THEN CAST(abs(v) AS DECIMAL(15,2)) END AS valor, CASE WHEN estado = 'linha' THEN raw END AS descricao_raw,
  CASE WHEN estado = 'linha' THEN w END AS direcao, CASE WHEN estado = 'linha' THEN nullif(trim(coalesce(cred_dev, '')), '') END AS cred_dev, CASE WHEN estado = 'linha' AND id % 14 = 1 THEN '100752' END AS nr_extrato_bancario,
  CASE WHEN estado = 'linha' AND length(rd) >= 3 THEN upper(strip_accents(rd)) END AS remetente_destinatario, CASE WHEN estado = 'linha' AND rotulo LIKE 'CPF%' THEN substr(rotulo, 5) END AS cpf, CASE WHEN estado = 'linha' AND rotulo LIKE 'CNPJ%' THEN substr(rotulo, 6) END AS cnpj FROM r""")(
    lambda i: extraction.rows_of(extraction.normalised(i), "id").drop("campos")
)
query("item_fields", "item", f"""
, f AS (SELECT id, unnest([{{'campo': 'data', 'v': data}}, {{'campo': 'valor', 'v': CAST(abs({_AMOUNT}) AS VARCHAR)}}, {{'campo': 'direcao', 'v': direcao}}, {{'campo': 'descricao', 'v': descricao}}, {{'campo': 'documento', 'v': documento}},
  {{'campo': 'hora', 'v': hora}}, {{'campo': 'saldo', 'v': saldo}}, {{'campo': 'remetente_destinatario', 'v': remetente_destinatario}}]) AS s FROM item)
SELECT id, s.campo AS campo, trim(s.v) AS valor FROM f WHERE trim(coalesce(s.v, '')) <> ''""")(
    lambda i: i.select("id", F.explode(extraction.field_map()).alias("campo", "valor"))
)


def _second(items: DataFrame) -> DataFrame:
    """The second reading of the fixture: some items missing, a longer party, another document."""
    party = F.when(F.col("id") % 3 == 0, "Ana Lima de Souza").otherwise(F.col("remetente_destinatario"))
    return items.where("id % 4 <> 0 OR id % 5 = 0").withColumns({"remetente_destinatario": party, "cpf": F.lit("52998224725")})


def _scores(items: DataFrame) -> DataFrame:
    return items.select("arquivo_id", "pagina", (F.col("id") % 11).cast("int").alias("indice")).distinct().withColumn("score", 70 + F.col("indice") * 3)


def _taken(items: DataFrame) -> DataFrame:
    return extraction.accepted(items, _second(items), _scores(items))


DUAL = f"""
, k AS (SELECT *, CASE WHEN regexp_full_match(data, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND upper(trim(direcao)) IN ('ENTRADA', 'SAIDA') THEN data || '|' || CAST(CAST(abs({_AMOUNT}) * 100 AS BIGINT) AS VARCHAR) || '|' || upper(trim(direcao)) END AS chave FROM item),
a AS (SELECT *, row_number() OVER (PARTITION BY arquivo_id, pagina, chave ORDER BY id) AS k, min(id) OVER (PARTITION BY arquivo_id, pagina, chave) AS p FROM k WHERE chave IS NOT NULL),
b AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'Ana Lima de Souza' ELSE remetente_destinatario END AS remetente_destinatario, '52998224725' AS cpf), row_number() OVER (PARTITION BY arquivo_id, pagina, chave ORDER BY id) AS k, min(id) OVER (PARTITION BY arquivo_id, pagina, chave) AS p
  FROM k WHERE chave IS NOT NULL AND (id % 4 <> 0 OR id % 5 = 0)),
u AS (SELECT coalesce(a.arquivo_id, b.arquivo_id) AS arquivo_id, coalesce(a.pagina, b.pagina) AS pagina, a.id AS id_a, b.id AS id_b, CASE WHEN a.id IS NULL THEN 'secundario' WHEN b.id IS NULL THEN 'primario' ELSE 'consenso' END AS origem, coalesce(a.p, b.p) AS p, coalesce(a.k, b.k) AS k,
  CASE WHEN length(trim(coalesce(b.remetente_destinatario, ''))) > length(trim(coalesce(a.remetente_destinatario, ''))) THEN b.remetente_destinatario WHEN a.id IS NULL THEN b.remetente_destinatario ELSE coalesce(a.remetente_destinatario, b.remetente_destinatario) END AS remetente_destinatario,
  coalesce(nullif(a.cpf, ''), b.cpf) AS cpf FROM a FULL JOIN b ON a.arquivo_id = b.arquivo_id AND a.pagina = b.pagina AND a.chave = b.chave AND a.k = b.k),
i AS (SELECT *, CASE WHEN origem <> 'consenso' THEN row_number() OVER (PARTITION BY arquivo_id, pagina, origem = 'consenso' ORDER BY origem, p, k) - 1 END AS indice FROM u),
s AS (SELECT DISTINCT arquivo_id, pagina, id % 11 AS indice FROM item),
t AS (SELECT i.*, CASE WHEN origem = 'consenso' THEN 100 WHEN s.indice IS NULL THEN 0 ELSE 70 + 3 * s.indice END AS score FROM i LEFT JOIN s ON i.arquivo_id = s.arquivo_id AND i.pagina = s.pagina AND i.indice = s.indice)
"""
query("dual_accepted", "item", DUAL + "SELECT arquivo_id, pagina, id_a, id_b, origem, CAST(indice AS INT) AS indice, CAST(score AS INT) AS score, remetente_destinatario, cpf FROM t")(
    lambda i: _taken(i).select("arquivo_id", "pagina", "id_a", "id_b", "origem", "indice", F.col("score").cast("int").alias("score"), "remetente_destinatario", "cpf")
)


def _pages(items: DataFrame) -> DataFrame:
    kept = items.where("arquivo_id % 5 <> 0")
    pages = items.select("arquivo_id", "pagina").distinct().withColumn("texto", F.when(F.col("arquivo_id") % 10 == 0, "curto").when(F.col("pagina") == 1, F.concat(F.lit("x" * 60), F.lit(" Saldo "))).otherwise("y" * 60))
    counts = kept.groupBy("arquivo_id", "pagina").agg(F.count("*").alias("lidas"))
    return extraction.page_states(pages, counts, _taken(kept))


query("page_states", "item", DUAL + """, p AS (SELECT DISTINCT arquivo_id, pagina FROM item), m AS (SELECT arquivo_id, pagina, min(score) AS menor FROM t GROUP BY arquivo_id, pagina)
SELECT p.arquivo_id, p.pagina, CASE WHEN p.arquivo_id % 10 = 0 OR (p.arquivo_id % 5 = 0 AND p.pagina = 1) THEN 'NAO_TRANSACIONAL' WHEN p.arquivo_id % 5 <> 0 AND menor >= 80 THEN 'OK' ELSE 'VERIFICAR' END AS estado
FROM p LEFT JOIN m ON p.arquivo_id = m.arquivo_id AND p.pagina = m.pagina""")(_pages)

query("cell_document", "celula", """
SELECT id, CASE WHEN k IN (3, 5, 9, 11) THEN 'PJ' WHEN k NOT IN (6, 7, 8) THEN 'PF' END AS tipo,
  CASE k WHEN 0 THEN '52998224725' WHEN 1 THEN '52998224725' WHEN 2 THEN '52998224725' WHEN 3 THEN '11222333000181' WHEN 4 THEN '00000000123' WHEN 5 THEN '11222333000181' WHEN 9 THEN 'ABCDEFGH000181' WHEN 10 THEN lpad(texto, 11, '0') WHEN 11 THEN '00112223330001' WHEN 12 THEN '00000001400' WHEN 13 THEN '00070000000' WHEN 14 THEN '00000000015' WHEN 15 THEN '00000000000' END AS documento,
  CASE WHEN k IN (6, 7) THEN 'Documento vazio' WHEN k IN (8) THEN 'Documento com tamanho inválido' END AS erro FROM (SELECT *, id % 16 AS k FROM celula)""")(
    lambda c: c.select("id", C.prepared_document(F.col("texto")).alias("d")).select("id", "d.*")
)
query("suggested_name", "celula", """
SELECT id, CASE id % 9 WHEN 0 THEN 'JOAO DA SILVA' WHEN 1 THEN 'ANA LIMA' WHEN 3 THEN 'DE FORNECEDOR DOCES' WHEN 5 THEN 'PIX' WHEN 6 THEN 'BIA SOUZA' WHEN 7 THEN 'TEDDY' ELSE '' END AS nome FROM celula""")(
    lambda c: c.select("id", C.suggested_name(F.col("descricao")).alias("nome"))
)
query("error_class", "celula", """
SELECT id, CASE WHEN contains(mensagem, 'OPENROUTER_API_KEY') OR (contains(lower(mensagem), 'openrouter http 401') AND contains(lower(mensagem), 'user not found')) THEN 'OPENROUTER_NAO_CONFIGURADO'
  WHEN regexp_matches(lower(mensagem), 'mais de \\d+ páginas') THEN 'PDF_MUITAS_PAGINAS' WHEN contains(lower(mensagem), 'openrouter http') THEN 'OPENROUTER_FALHA' WHEN contains(lower(mensagem), 'invalid pdf') THEN 'PDF_INVALIDO'
  WHEN contains(lower(mensagem), 'blob') THEN 'STORAGE_FALHA' WHEN contains(lower(mensagem), 'sem texto') THEN 'PDF_SEM_TEXTO_E_VISAO_FALHOU' ELSE 'INGESTAO_DESCONHECIDA' END AS codigo FROM celula""")(
    lambda c: c.select("id", C.error_class(F.col("mensagem")).alias("codigo"))
)
query("soft_delete", "movimentacao", """
SELECT i.id, CASE WHEN m.id IS NULL THEN 'MOVIMENTACAO_NOT_FOUND' WHEN deletado THEN 'MOVIMENTACAO_DELETED' WHEN status = 'EXPORTADO' THEN 'MOVIMENTACAO_EXPORTADA' WHEN status = 'CONFIRMADO' THEN 'MOVIMENTACAO_CONFIRMADA' ELSE 'excluida' END AS resultado
FROM (SELECT id FROM movimentacao UNION SELECT -id FROM movimentacao) i LEFT JOIN movimentacao m ON i.id = m.id""")(
    lambda m: mutations.soft_delete(m, m.select(F.explode(F.array("id", -F.col("id"), "id")).alias("id")))
)
query("edit_fold", "movimentacao", """
SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 <> 0 THEN 7 END ELSE pessoa_id END AS pessoa_id, CASE WHEN id % 6 = 0 THEN 'segunda' ELSE descricao_raw END AS descricao_raw FROM movimentacao""")(
    lambda m: mutations.edited(
        m.select("id", "pessoa_id", "descricao_raw"),
        m.where("id % 4 = 0").select("id", F.lit("pessoa_id").alias("campo"), F.when(F.col("id") % 8 != 0, "7").alias("valor"), F.lit(1).alias("ordem"))
        .union(m.where("id % 6 = 0").select("id", F.lit("descricao_raw"), F.explode(F.map_from_arrays(F.array(F.lit("segunda"), F.lit("primeira")), F.array(F.lit(9), F.lit(3)))).alias("valor", "ordem"))),
        ("pessoa_id", "descricao_raw"),
    )
)
query("directory_upsert", "prestador", """
SELECT cnpj_prestador, CASE WHEN cnpj_prestador % 3 = 0 THEN 'Novo' ELSE nome_municipal END AS nome, CASE WHEN cnpj_prestador % 3 = 0 THEN 2 ELSE 0 END AS ordem FROM prestador UNION ALL SELECT -1 - cnpj_prestador, 'Outro', 1 FROM prestador""")(
    lambda p: mutations.upserted(
        p.select("cnpj_prestador", F.col("nome_municipal").alias("nome"), F.lit(0).alias("ordem")),
        (t := p.where("cnpj_prestador % 3 = 0")).select("cnpj_prestador", F.lit("Velho").alias("nome"), F.lit(1).alias("ordem")).union(t.select("cnpj_prestador", F.lit("Novo"), F.lit(2))).union(p.select((-1 - F.col("cnpj_prestador")).cast("long"), F.lit("Outro"), F.lit(1))),
        ("cnpj_prestador",), "ordem",
    )
)
query("purge_sessions", "movimentacao evidencia", "SELECT movimentacao_id, tipo, peso FROM evidencia WHERE movimentacao_id NOT IN (SELECT id FROM movimentacao WHERE sessao_id % 3 = 0)")(
    lambda m, e: mutations.purged({"mov": m, "ev": e}, {"mov": "id", "ev": "movimentacao_id"}, "mov", m.where("sessao_id % 3 = 0"))["ev"]
)
query("batch_approvable", "movimentacao", "SELECT id FROM movimentacao WHERE status = 'PENDENTE_REVISAO' AND confianca >= 0.85 AND pessoa_id IS NOT NULL")(lambda m: mutations.batch_approvable(m).select("id"))
def _spending(m: DataFrame, c: DataFrame, p: DataFrame) -> DataFrame:
    lines = m.withColumn("pessoa_juridica_id", F.when(F.col("id") % 4 == 1, F.col("id") % 10 + 1))
    more = c.withColumns({
        "descricao_resumida": F.when(F.col("movimentacao_id") % 2 == 0, "Resumo & mais de vinte letras"), "nr_documento": F.when(F.col("movimentacao_id") % 3 == 0, "77"), "data_emissao": F.lit(None).cast("date"),
        "tipo_documento": F.when(F.col("movimentacao_id") % 5 == 0, "outro").when(F.col("movimentacao_id") % 5 == 1, "FISCAL"), "detalhe_situacao": F.when(F.col("movimentacao_id") % 7 == 0, 2), "cd_gasto": F.when(F.col("movimentacao_id") % 11 == 0, "410"),
    })
    return export.application_items(lines, more, p).select("id", "xml", "erro")


query("application_xml", "movimentacao classificacao pessoa", """
, g AS (SELECT m.*, j.documento AS jd, j.nome AS jn, f.documento AS fd, f.nome AS fn, CASE WHEN m.id % 2 = 0 THEN 'Resumo &amp; mais de vinte letras' ELSE descricao_raw END AS texto, CASE WHEN m.id % 2 = 0 THEN 'Resumo &amp; mais de vinte'[:24] ELSE substr(descricao_raw, 1, 20) END AS curto,
  CASE WHEN m.id % 3 = 0 THEN '<nrDocumento>77</nrDocumento>' ELSE '' END || '<dataEmissaoContratacao>' || CAST(data_movimento AS VARCHAR) || '</dataEmissaoContratacao><vrTotalDocumento>' || CAST(valor AS VARCHAR) || '</vrTotalDocumento>' AS doc
  FROM movimentacao m JOIN classificacao c ON m.id = c.movimentacao_id LEFT JOIN pessoa j ON j.tipo = 'PJ' AND m.id % 4 = 1 AND j.pessoa_id = m.id % 10 + 1 LEFT JOIN pessoa f ON f.tipo = 'PF' AND f.pessoa_id = m.pessoa_id WHERE direcao = 'SAIDA' AND status = 'CONFIRMADO')
SELECT id, '<gasto><pessoa>' || CASE WHEN jd IS NOT NULL THEN '<pessoaJuridica><nrCnpj>' || jd || '</nrCnpj><nmPessoa>' || jn || '</nmPessoa></pessoaJuridica>' WHEN fd IS NOT NULL THEN '<pessoaFisica><nrCpf>' || fd || '</nrCpf><nmPessoa>' || fn || '</nmPessoa></pessoaFisica>' END || '</pessoa><dadosDocumento>' ||
  CASE id % 5 WHEN 0 THEN '<outro><descricao>' || curto || '</descricao>' || doc || '</outro>' WHEN 1 THEN '<fiscal>' || doc || '</fiscal>' ELSE '<recibo>' || doc || '</recibo>' END || '</dadosDocumento><classificacaoGasto><gastoContaContabil><cdDescricaoGasto>' || CASE WHEN id % 11 = 0 THEN '410' ELSE '401' END || '</cdDescricaoGasto><vrGasto>' || CAST(valor AS VARCHAR) || '</vrGasto>' ||
  CASE WHEN id % 7 = 0 THEN '' ELSE '<situacao1><descricaoResumida>' || texto || '</descricaoResumida></situacao1>' END || '</gastoContaContabil></classificacaoGasto></gasto>' AS xml, CASE WHEN jd IS NULL AND fd IS NULL THEN 'sem pessoa' END AS erro FROM g""")(_spending)


# A statement of 200 lines is a file of eight pages.


def _statement(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text items of pages and the ledger lines to be found on them, from extracted items."""
    # Written before it is filtered: a filter pushed down would take the state's expression anew for each column.
    rows = written(extraction.rows_of(extraction.normalised(items), "id", "hora"), "rows").where("situacao = 'linha'")
    rows = written(rows.selectExpr("*", "id div 200 _file", "id % 200 _at", "CASE WHEN id % 5 < 2 THEN cast(id % 200 + 4000 AS string) END _doc"), "statement")
    page = F.expr("cast(_at div 25 + 1 AS int)")
    parts = F.array_compact(F.array(F.date_format("data_movimento", "dd/MM/yyyy"), F.coalesce("remetente_destinatario", F.lit("SEM NOME")), F.element_at(C.amount_texts(F.col("valor")), 1), F.when(F.col("id") % 6 == 0, F.col("hora")), F.when(F.col("id") % 5 == 0, F.col("_doc"))))
    texts = rows.select(F.col("_file").alias("arquivo_id"), page.alias("pagina"), F.expr("(_at % 25 + 1) / 27D").alias("y"), F.posexplode(parts).alias("k", "str"))
    texts = texts.select("arquivo_id", "pagina", (F.col("k") * 0.2).alias("x"), "y", F.lit(0.2).alias("width"), F.lit(0.01).alias("height"), "str")
    declared = F.when(F.col("id") % 7 != 3, page).otherwise(F.lit(None).cast("int"))
    wanted = rows.select("id", F.col("_file").alias("arquivo_id"), declared.alias("pagina"), "data_movimento", F.col("valor").cast("string").alias("valor"), "descricao_raw", "remetente_destinatario", F.col("_doc").alias("documento"), "hora", (F.col("_file") % 2 == 0).alias("relaxa"), (F.col("id") % 9 == 0).alias("ancorada"))
    return texts, wanted


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(strip_accents({c})), '[^a-z0-9]+'), lambda t: length(t) > 1)"


# The page lines and the sought lines, paired within a file, and the points by the score table.
LOCATE = ROWS + rf""", g AS (SELECT id, hora, CAST(data AS DATE) AS dia, CAST(abs(v) AS DECIMAL(15,2)) AS valor, raw, CASE WHEN length(rd) >= 3 THEN upper(strip_accents(rd)) END AS parte, id AS lugar FROM r WHERE estado = 'linha'),
st AS (SELECT id, lugar // 200 AS arquivo, lugar % 200 AS em, (lugar % 200) // 25 + 1 AS pagina, dia, valor, raw, parte, hora, CASE WHEN id % 5 < 2 THEN CAST(lugar % 200 + 4000 AS VARCHAR) END AS doc FROM g),
fm AS (SELECT *, replace(CAST(valor AS VARCHAR), '.', ',') AS virgula FROM st),
gr AS (SELECT *, CASE WHEN valor >= 1000 THEN left(virgula, length(virgula) - 6) || '.' || right(virgula, 6) ELSE virgula END AS milhar FROM fm),
pl AS (SELECT arquivo, pagina, em % 25 AS linha, strftime(dia, '%d/%m/%Y') || ' ' || coalesce(parte, 'SEM NOME') || ' ' || milhar || CASE WHEN id % 6 = 0 AND hora IS NOT NULL THEN ' ' || hora ELSE '' END || CASE WHEN id % 5 = 0 THEN ' ' || doc ELSE '' END AS texto FROM gr),
wa AS (SELECT *, arquivo % 2 = 0 AS relaxa, {_tokens(r"regexp_replace(regexp_replace(concat_ws(' ', parte, nullif(trim(raw), '')), '([0-9]{14}|[0-9]{11})', '', 'g'), '(?i)(CPF|CNPJ)[:\s]*', '', 'g')")} AS procura FROM gr),
jn AS (SELECT wa.*, pl.pagina AS onde, pl.linha, pl.texto, contains(pl.texto, virgula) OR contains(pl.texto, milhar) OR contains(pl.texto, CAST(valor AS VARCHAR)) AS cv, contains(pl.texto, strftime(dia, '%d/%m')) AS cd, doc IS NOT NULL AND contains(regexp_replace(pl.texto, '[^0-9]', '', 'g'), doc) AS cc,
  CASE WHEN length(parte) > 3 THEN contains(pl.texto, parte) END AS mesmo FROM wa JOIN pl ON wa.arquivo = pl.arquivo),
sc AS (SELECT *, CASE WHEN cc AND cd THEN 25 WHEN cd THEN 10 ELSE 1 END + CASE WHEN cv THEN 5 ELSE 0 END + 5 * len(list_filter({_tokens("texto")}, lambda t: list_contains(procura, t))) + CASE WHEN mesmo THEN 50 ELSE 0 END
  + CASE WHEN doc IS NULL THEN 0 WHEN cc THEN 40 WHEN relaxa THEN 0 ELSE -5 END + CASE WHEN hora IS NOT NULL AND contains(texto, hora) THEN 15 ELSE 0 END AS pontos
  FROM jn WHERE ((cc AND cd) OR (cv AND (cd OR relaxa))) AND coalesce(mesmo, true))
"""
query("pdf_line_locate", "item", LOCATE + """, mm AS (SELECT id, onde, pontos, row_number() OVER (PARTITION BY id ORDER BY pontos DESC, onde, linha) AS k FROM sc WHERE pontos >= 1)
SELECT st.id, CAST(onde AS INT) AS pagina, CAST(pontos AS INT) AS pontos, CASE WHEN pontos IS NULL THEN 'Nenhuma linha com valor e data na mesma linha' END AS motivo FROM st LEFT JOIN mm ON st.id = mm.id AND k = 1""")(
    lambda i: locate.located(locate.page_lines((t := _statement(i))[0]), t[1].drop("pagina", "ancorada")).select("id", "pagina", "pontos", "motivo")
)
query("pdf_anchor", "item", LOCATE + """, ds AS (SELECT DISTINCT arquivo, pagina FROM st WHERE id % 9 <> 0 AND id % 7 <> 3),
mm AS (SELECT sc.id, onde, pontos, row_number() OVER (PARTITION BY sc.id ORDER BY ds.pagina IS NULL, pontos DESC, onde, linha) AS k FROM sc LEFT JOIN ds ON sc.arquivo = ds.arquivo AND sc.onde = ds.pagina WHERE pontos >= 1)
SELECT st.id, CAST(coalesce(onde, CASE WHEN st.id % 7 <> 3 THEN pagina END) AS INT) AS pagina, CAST(pontos AS INT) AS pontos, CASE WHEN pontos IS NULL THEN 'nao_localizado' ELSE 'text_layer' END AS ancoragem FROM st LEFT JOIN mm ON st.id = mm.id AND k = 1 WHERE st.id % 9 <> 0""")(
    lambda i: locate.anchored(locate.page_lines((t := _statement(i))[0]), t[1]).select("id", "pagina", "pontos", "ancoragem")
)
query("approved_file", "movimentacao pessoa prestador")(lambda m, p, r: export.approved_file(ledger.described(ledger.approved(m), p, r).withColumnsRenamed({"documento": "pessoa_documento", "confianca": "confianca_global"})))


def _damaged(m: DataFrame, c: DataFrame, p: DataFrame) -> DataFrame:
    """Fragments of three kinds, those of origem damaged in four ways."""
    k = F.col("id") % 12
    xml = F.col("xml")
    broken = F.when(k == 0, F.regexp_replace(xml, "<valor>[^<]*</valor>", "")).when(k == 1, F.regexp_replace(xml, "(<dataMovimento>[^<]*</dataMovimento>)(<valor>[^<]*</valor>)", "$2$1")).when(k == 2, F.replace(xml, F.lit("</origem>"), F.lit("<mais/></origem>"))).when(k == 3, F.substring(xml, 1, 30)).otherwise(xml)
    items = export.origin_items(m, c, p).select("id", F.lit("origem").alias("documento"), broken.alias("xml"))
    return items.unionByName(export.application_items(m.withColumn("pessoa_juridica_id", F.lit(None).cast("long")), c.withColumns({n: F.lit(None).cast(t) for n, t in (("descricao_resumida", "string"), ("nr_documento", "string"), ("data_emissao", "date"), ("tipo_documento", "string"), ("detalhe_situacao", "int"), ("cd_gasto", "string"))}), p).select("id", F.lit("aplicacao").alias("documento"), "xml"))


def _validated(m: DataFrame, c: DataFrame, p: DataFrame) -> DataFrame:
    # The workers get the schema by its name.
    m.sparkSession.sparkContext.addFile(os.path.join(os.path.dirname(os.path.dirname(__file__)), "schemas", "origem.xsd"))
    return validation.validated(_damaged(m, c, p), {"origem": "origem.xsd"}).select("id", "documento", "validacao")


query("xsd_validation", "movimentacao classificacao pessoa", """
SELECT m.id, CASE WHEN direcao = 'ENTRADA' THEN 'origem' ELSE 'aplicacao' END AS documento, CASE WHEN direcao <> 'ENTRADA' THEN 'nao_validado' WHEN m.id % 12 < 4 THEN 'invalido' ELSE 'valido' END AS validacao FROM movimentacao m JOIN classificacao c ON m.id = c.movimentacao_id WHERE status = 'CONFIRMADO'""")(_validated)


def _twice(items: DataFrame) -> DataFrame:
    """Two runs over texts: half of them, then all; what each run found new, and the answers after the second."""
    spark = items.sparkSession
    path = fresh_path(spark, "cache")
    texts = items.select("id", F.concat_ws(";", "data", "valor", "descricao").alias("conteudo"), F.lit("m1").alias("modelo"))
    answer = lambda new: new.select("chave", F.when(F.length("conteudo") % 5 > 0, F.upper("conteudo")).alias("resposta"))
    first = incremental.extracted(texts.where("id % 2 = 0"), path, answer)[1]
    done, second = incremental.extracted(texts, path, answer)
    return done.select("id", "resposta", F.lit(first).alias("novas_1"), F.lit(second).alias("novas_2"))


query("extraction_cache", "item", """
, t AS (SELECT id, concat_ws(';', data, valor, descricao) AS c FROM item), a AS (SELECT DISTINCT c FROM t WHERE id % 2 = 0)
SELECT id, CASE WHEN length(c) % 5 > 0 THEN upper(c) END AS resposta, (SELECT count(*) FROM a) AS novas_1, (SELECT count(DISTINCT c) FROM t WHERE length(c) % 5 = 0 OR c NOT IN (SELECT c FROM a)) AS novas_2 FROM t""")(_twice)

# A statement's first page for every item: titles in an order that its number turns, and one line below them.
TITLES = ("Data", "Valor (R$)", "Nr. Doc", "Histórico", "Favorecido", "Saldo", "D/C")
_CAMPOS = ("data", "valor", "documento", "historico", "remetente_destinatario", "saldo", "direcao")


def _headed(items: DataFrame) -> DataFrame:
    slot = lambda j: (F.lit(j * 3) + F.col("id")) % 7
    texts = []
    for j, title in enumerate(TITLES):
        for k, part in enumerate(title.split(" ") if title == "Nr. Doc" else [title]):
            texts.append(F.struct((F.lit(20.0) + slot(j) * 90 + k * 15).alias("x"), F.lit(100.0).alias("y"), F.when((F.col("id") % 10 > 0) | F.lit(j == 0), part).otherwise("x").alias("str")))
        texts.append(F.struct((F.lit(24.0) + slot(j) * 90).alias("x"), F.lit(140.0).alias("y"), F.concat(F.lit(f"v{j} "), F.col("id").cast("string")).alias("str")))
    return items.select("id", F.posexplode(F.array(*texts)).alias("ordem", "t")).select("id", "ordem", "t.x", "t.y", "t.str", F.lit(650.0).alias("largura"))


_SLOTS = "(SELECT id, unnest(range(7)) AS j, (unnest(range(7)) * 3 + id) % 7 AS s FROM item WHERE id % 10 > 0)"
query("header_columns", "item", f"""
SELECT id, CAST(s AS INT) AS coluna_index, {list(_CAMPOS)}[j + 1] AS campo, {list(TITLES)}[j + 1] AS titulo, CASE WHEN s = 0 THEN CAST(0 AS DOUBLE) ELSE (CAST(20 + (s - 1) * 90 AS DOUBLE) / 650 + CAST(20 + s * 90 AS DOUBLE) / 650) / 2 END AS x_inicio,
  CASE WHEN s = 6 THEN CAST(1 AS DOUBLE) ELSE (CAST(20 + s * 90 AS DOUBLE) / 650 + CAST(20 + (s + 1) * 90 AS DOUBLE) / 650) / 2 END AS x_fim FROM {_SLOTS}""")(
    lambda i: columns.header_columns(_headed(i), "id")
)
query("column_texts", "item", f"SELECT id, {list(_CAMPOS)}[j + 1] AS campo, 'v' || j || ' ' || id AS texto FROM {_SLOTS}")(
    lambda i: columns.field_texts((t := _headed(i)).where("y > 120"), columns.header_columns(t, "id"), "id").select("id", F.explode("campos").alias("campo", "texto"))
)

# The same text runs in Spark and in DuckDB.
ORIGIN_LINES = "SELECT *, CASE WHEN id % 4 = 1 THEN id % 10 + 1 END AS pessoa_juridica_id, CASE WHEN id % 3 > 0 THEN id % 6 END AS conta_id, CASE WHEN id % 5 < 3 THEN 'N<' || CAST(id % 90 AS VARCHAR(3)) END AS nr_extrato_bancario FROM {m}"
ORIGIN_CLASSES = "SELECT movimentacao_id, fonte_recurso, natureza_recurso, CASE movimentacao_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'pj' WHEN 2 THEN 'XX' WHEN 5 THEN 'PJ' ELSE 'PF' END AS tipo_origem_recurso, CASE WHEN movimentacao_id % 2 = 0 THEN '1.2' END AS classificacao_receita, CASE WHEN movimentacao_id % 3 = 0 THEN 'Resumo & mais' END AS descricao_resumida, nr_recibo_doacao, CASE movimentacao_id % 12 WHEN 0 THEN 'pix' WHEN 1 THEN 'TED' WHEN 2 THEN 'TEL' WHEN 3 THEN 'TEB' WHEN 4 THEN 'CH' WHEN 5 THEN 'EP' WHEN 6 THEN 'OB' WHEN 7 THEN 'CC' WHEN 8 THEN 'AC' WHEN 9 THEN 'OT' WHEN 10 THEN 'ZZ' END AS especie_recurso FROM {c}"
ORIGIN_PEOPLE = "SELECT *, CASE WHEN tipo = 'PF' AND pessoa_id % 3 = 0 THEN 'T' || CAST(pessoa_id AS VARCHAR(9)) END AS titulo_eleitor FROM {p}"
ACCOUNTS = "SELECT DISTINCT id % 5 AS conta_id, '0' || CAST(id % 5 AS VARCHAR(3)) AS agencia, '77' || CAST(id % 5 AS VARCHAR(3)) AS conta, CASE WHEN id % 5 = 2 THEN 'X' END AS dv FROM {m}"
_ELEMENT = "CASE WHEN coalesce(CAST({1} AS VARCHAR), '') <> '' THEN '<{0}>' || replace(replace(CAST({1} AS VARCHAR), '&', '&amp;'), '<', '&lt;') || '</{0}>' ELSE '' END"
_SLOT = _ELEMENT.replace("ELSE ''", "ELSE '<{0}/>'")
_MONEY = "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in export.MONEY_TAGS.items()) + " ELSE 'transferenciaEletronicaPIX' END"
query("origin_fragments", "movimentacao classificacao pessoa", f"""
, l AS ({ORIGIN_LINES.format(m="movimentacao")}), k AS ({ORIGIN_CLASSES.format(c="classificacao")}), q AS ({ORIGIN_PEOPLE.format(p="pessoa")}), a AS ({ACCOUNTS.format(m="movimentacao")}),
g AS (SELECT l.*, k.* EXCLUDE (movimentacao_id), upper(coalesce(tipo_origem_recurso, 'PF')) AS t, upper(coalesce(especie_recurso, 'PIX')) AS e, f.documento AS fd, f.nome AS fn, f.titulo_eleitor AS ft, j.documento AS jd, j.nome AS jn, a.agencia, a.conta, a.dv, a.conta_id AS ac FROM l JOIN k ON l.id = movimentacao_id LEFT JOIN q f ON f.tipo = 'PF' AND f.pessoa_id = l.pessoa_id
  LEFT JOIN q j ON j.tipo = 'PJ' AND j.pessoa_id = l.pessoa_juridica_id LEFT JOIN a ON a.conta_id = l.conta_id WHERE direcao = 'ENTRADA' AND status = 'CONFIRMADO'),
r AS (SELECT *, CASE WHEN t = 'PF' AND fd IS NULL THEN 'sem pessoa física' WHEN t = 'PJ' AND jd IS NULL THEN 'sem pessoa jurídica' WHEN t NOT IN ('PF', 'PJ') THEN 'tipo de origem: ' || t END AS erro, {_MONEY} AS tag FROM g)
SELECT id, CASE WHEN erro IS NULL THEN '<origem>' || {_SLOT.format("dtEntrada", "data_movimento")} || {_SLOT.format("vrOrigem", "valor")} || {_SLOT.format("fonteRecurso", "fonte_recurso")} || {_SLOT.format("naturezaRecurso", "natureza_recurso")} || '<origemRecurso>' ||
  CASE t WHEN 'PF' THEN '<pessoaFisica><tipo>PF</tipo>' || {_SLOT.format("nrCpf", "fd")} || {_SLOT.format("nmPessoa", "fn")} || {_ELEMENT.format("tituloEleitor", "ft")} || '</pessoaFisica>' ELSE '<pessoaJuridica><tipo>PJ</tipo>' || {_SLOT.format("nrCnpj", "jd")} || {_SLOT.format("nmPessoa", "jn")} || '</pessoaJuridica>' END || '</origemRecurso>' ||
  {_SLOT.format("classificacaoReceita", "classificacao_receita")} || {_ELEMENT.format("nrReciboDoacao", "nr_recibo_doacao")} || {_ELEMENT.format("descricaoResumida", "descricao_resumida")} || '<especieRecurso><' || tag || '>' || {_ELEMENT.format("especieRecurso", "e")} || {_ELEMENT.format("nrExtratoBancario", "nr_extrato_bancario")} ||
  CASE WHEN e = 'OT' THEN '' ELSE '<contaBancariaDestino><bancoDestino><nrBancoDestino>000</nrBancoDestino><agenciaDestino>' || CASE WHEN ac IS NULL THEN '0000' ELSE agencia END || '</agenciaDestino><contaCorrente>' || CASE WHEN ac IS NULL THEN '0' ELSE conta END || '</contaCorrente><dvContaCorrente>' || coalesce(dv, '0') || '</dvContaCorrente></bancoDestino></contaBancariaDestino>' END ||
  '</' || tag || '></especieRecurso></origem>' END AS xml, erro FROM r""")(
    lambda m, c, p: export.origin_fragments((s := m.sparkSession).sql(ORIGIN_LINES, m=m), s.sql(ORIGIN_CLASSES, c=c), s.sql(ORIGIN_PEOPLE, p=p), s.sql(ACCOUNTS, m=m)).select("id", "xml", "erro")
)
