"""Registered queries over review sheets, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import sheet
from ledgerloom.operators.storage import written
from ledgerloom.plans.registered import query

# The same text runs in Spark and in DuckDB.
LINES = """SELECT id, sessao_id, data_movimento, valor, direcao, CASE WHEN id % 6 = 1 THEN 'Pgto João CPF 529.982.247-25' ELSE descricao_raw END AS descricao_raw, CASE WHEN id % 5 = 2 THEN '9' || CAST(id % 90 AS VARCHAR(9)) END AS nr_extrato_bancario,
  confianca, pessoa_id, arquivo_id, CASE id % 6 WHEN 0 THEN 'Customer#00000000' || CAST(id % 5 + 1 AS VARCHAR(2)) WHEN 1 THEN ' ab ' WHEN 2 THEN 'customer' WHEN 3 THEN 'Outra Pessoa' END AS remetente_destinatario,
  id % 3 <> 1 AS tem_origem, CASE WHEN id % 3 <> 1 THEN id % 50 END AS indice_linha, CASE WHEN id % 12 = 0 THEN '08:05:30' END AS hora, deletado, canonica_id,
  CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN '10:0' || CAST(id % 10 AS VARCHAR(1)) WHEN 2 THEN '9:30' WHEN 3 THEN 'cedo' END AS c_hora, CASE WHEN id % 4 = 1 THEN 'D' || CAST(id % 30 AS VARCHAR(9)) WHEN id % 4 = 2 THEN '' END AS c_documento,
  CASE WHEN id % 7 = 2 THEN 'Campo Nome' WHEN id % 7 = 3 THEN '' END AS c_remetente, CASE WHEN id % 8 = 3 THEN 'hist' END AS c_historico FROM {m}"""
EVENTS = """SELECT id AS evento_id, sessao_id, CASE id % 5 WHEN 0 THEN 'REJEITADO' WHEN 1 THEN 'APROVADO' ELSE 'PENDENTE' END AS status, id % 29 = 0 AS deletado, data_movimento, valor, direcao, CAST(id * 13 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confianca,
  CASE WHEN id % 2 = 0 THEN 'mesmo valor' END AS justificativa, CASE WHEN id % 4 <> 0 THEN pessoa_id END AS pessoa_id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'customer' WHEN 2 THEN 'Xavier Outro' ELSE ' x ' END AS remetente_destinatario FROM {m} WHERE id % 3 = 0 AND sessao_id % 4 <> 0"""
MEMBERS = """SELECT e.id AS evento_id, k.posicao, m.id, CASE (m.id * 31 + e.id) % 3 WHEN 0 THEN 'PIX' WHEN 1 THEN 'COMPLETO' ELSE 'OUTRO' END AS papel
  FROM {m} e, (SELECT 0 AS posicao UNION ALL SELECT 1 UNION ALL SELECT 2) k, {m} m WHERE e.id % 3 = 0 AND e.sessao_id % 4 <> 0 AND m.id = e.id + CASE k.posicao WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 3 END AND (k.posicao < 2 OR e.id % 2 = 0)"""
EVIDENCE = " UNION ALL ".join(f"SELECT id AS movimentacao_id, '{kind}' AS tipo FROM {{m}} WHERE {where}" for kind, where in (("PAGINA_VERIFICAR", "id % 11 = 0"), ("EXTRACAO_CONFIRMADA", "id % 7 = 0"), ("CPF_CADASTRO", "id % 4 = 1"), ("CPF_SEM_CADASTRO", "id % 4 = 2"), ("CONFLITO_NOME", "id % 23 = 0"), ("NOME_DIVERGE_CADASTRO", "id % 19 = 0"), ("IA", "id % 2 = 0")))
FIELDS = {"hora": "c_hora", "documento": "c_documento", "remetente_destinatario": "c_remetente", "historico": "c_historico"}
FILES = "SELECT DISTINCT sessao_id, arquivo_id FROM {m}"
PAGES = "SELECT DISTINCT arquivo_id, CAST(id % 5 + 1 AS INT) AS pagina, CASE WHEN (arquivo_id + id % 5) % 3 = 0 THEN 'VERIFICAR' ELSE 'OK' END AS status, CAST(id % 5 * 2 AS INT) AS aceitas, CAST(0 AS INT) AS incertas, CAST(NULL AS VARCHAR(9)) AS motivo FROM {m}"


def case(m: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines, evidence, events, their lines and people of the fixture."""
    person = F.when(F.col("pessoa_id").isNotNull(), F.struct(F.lit("PF").alias("tipo"), F.col("pessoa_id").cast("long").alias("id")))
    text = lambda t: m.sparkSession.sql(t, m=m)
    fields = F.create_map(*[x for name, c in FIELDS.items() for x in (F.lit(name), F.col(c))])
    lines = text(LINES).withColumns({"pessoa": person, "campos": fields}).drop("pessoa_id", *FIELDS.values())
    return lines, text(EVIDENCE), text(EVENTS).withColumn("pessoa", person).drop("pessoa_id"), text(MEMBERS), p


def rows(m: DataFrame, p: DataFrame) -> DataFrame:
    return sheet.sheet(*case(m, p))


_AGREE = "CASE WHEN length(trim(coalesce({0}, ''))) < 4 THEN 'indefinido' WHEN contains(upper(nome), upper(trim({0}))) OR contains(upper(trim({0})), upper(nome)) THEN 'bate' ELSE 'difere' END"
_TIER = "CASE WHEN list_contains(ks, 'CONFLITO_NOME') THEN 'REJEITADO' WHEN nome IS NOT NULL THEN CASE WHEN list_contains(ks, 'CPF_CADASTRO') AND comp = 'bate' THEN 'ALTA' ELSE 'MEDIA' END WHEN list_contains(ks, 'CPF_SEM_CADASTRO') THEN 'BAIXA' END"
_STATE = "CASE WHEN duvida AND nome IS NULL THEN 'extracao_duvidosa' WHEN pendente AND n >= 2 THEN 'merge_pendente' WHEN nome IS NOT NULL AND confianca >= 0.6 THEN 'pronta' ELSE 'pendente' END"
_LINKS = ", ".join(f"'{k}'" for k in sheet.LINK_EVIDENCE)
# Rows of the sheet as s; f are the first values of the fields, by line order.
SHEET = f""", l AS ({LINES.format(m="movimentacao")}), ev AS ({EVIDENCE.format(m="movimentacao")}), e AS (SELECT * FROM ({EVENTS.format(m="movimentacao")}) WHERE NOT deletado), k AS ({MEMBERS.format(m="movimentacao")}),
vivas AS (SELECT * FROM l WHERE NOT deletado AND canonica_id IS NULL),
mk AS (SELECT k.*, coalesce(nullif(c_documento, ''), nr_extrato_bancario) AS doc, l.descricao_raw, tem_origem, indice_linha, nullif(l.hora, '') AS hora_o, c_hora, c_documento, c_remetente, c_historico FROM k JOIN l ON k.id = l.id),
g AS (SELECT evento_id, count(*) AS n, arg_min(descricao_raw, (papel <> 'COMPLETO', posicao)) AS descricao_raw, arg_min(coalesce(doc, ''), (papel <> 'COMPLETO', posicao)) AS doc, bool_or(NOT tem_origem) AS sem, min(indice_linha) AS indice,
  arg_min(hora_o, posicao) FILTER (WHERE hora_o IS NOT NULL) AS hora_o, {", ".join(f"arg_min({c}, posicao) FILTER (WHERE {c} <> '') AS {c}" for c in FIELDS.values())} FROM mk GROUP BY evento_id),
x AS (SELECT k.evento_id, list(DISTINCT tipo) FILTER (WHERE tipo IN ({_LINKS})) AS ks, bool_or(tipo = 'EXTRACAO_CONFIRMADA') AS conf FROM k JOIN ev ON k.id = ev.movimentacao_id GROUP BY k.evento_id),
y AS (SELECT movimentacao_id, list(DISTINCT tipo) AS ks, bool_or(tipo = 'EXTRACAO_CONFIRMADA') AS conf, bool_or(tipo = 'PAGINA_VERIFICAR') AS olhar FROM ev GROUP BY movimentacao_id),
se AS (SELECT 'consolidacao' AS fonte, e.evento_id AS id, e.sessao_id, e.data_movimento, e.valor, e.confianca, g.n, g.descricao_raw, nullif(g.doc, '') AS doc, g.indice, coalesce(nullif(c_hora, ''), hora_o) AS hora, coalesce(nullif(c_remetente, ''), e.remetente_destinatario) AS remetente, c_documento, c_historico,
  coalesce(ks, []) AS ks, coalesce(conf, false) AS conf, sem AND e.confianca < 0.4 AND NOT coalesce(conf, false) AS duvida, e.status = 'PENDENTE' AS pendente, nome, CASE WHEN nome IS NOT NULL THEN {_AGREE.format("e.remetente_destinatario")} END AS comp, e.status AS evento_status
  FROM e JOIN g ON e.evento_id = g.evento_id LEFT JOIN x ON e.evento_id = x.evento_id LEFT JOIN pessoa q ON q.tipo = 'PF' AND q.pessoa_id = e.pessoa_id WHERE e.status <> 'REJEITADO'),
mostradas AS (SELECT DISTINCT e.sessao_id, k.id FROM e JOIN k ON e.evento_id = k.evento_id WHERE e.status <> 'REJEITADO'),
perdidas AS (SELECT DISTINCT e.sessao_id, k.id FROM e JOIN k ON e.evento_id = k.evento_id WHERE e.status = 'REJEITADO' EXCEPT SELECT * FROM mostradas),
so AS (SELECT vivas.* FROM vivas WHERE sessao_id NOT IN (SELECT sessao_id FROM e) UNION ALL SELECT vivas.* REPLACE (perdidas.sessao_id AS sessao_id) FROM vivas JOIN perdidas ON vivas.id = perdidas.id),
sl AS (SELECT 'movimentacao' AS fonte, so.id, so.sessao_id, data_movimento, valor, confianca, 1 AS n, descricao_raw, nr_extrato_bancario AS doc, indice_linha AS indice, coalesce(nullif(c_hora, ''), nullif(hora, '')) AS hora, coalesce(nullif(c_remetente, ''), remetente_destinatario) AS remetente, c_documento, c_historico,
  coalesce(ks, []) AS ks, coalesce(conf, false) AS conf, (coalesce(olhar, false) OR (NOT tem_origem AND confianca < 0.4)) AND NOT coalesce(conf, false) AS duvida, false AS pendente, nome, CASE WHEN nome IS NOT NULL THEN {_AGREE.format("remetente_destinatario")} END AS comp, NULL AS evento_status
  FROM so LEFT JOIN y ON so.id = y.movimentacao_id LEFT JOIN pessoa q ON q.tipo = 'PF' AND q.pessoa_id = so.pessoa_id),
s AS (SELECT *, {_STATE} AS estado, CASE WHEN fonte = 'movimentacao' OR len(ks) > 0 THEN {_TIER} END AS nivel FROM (SELECT * FROM se UNION ALL SELECT * FROM sl))
"""
VIEWS = "movimentacao pessoa"
query("sheet_rows", VIEWS, SHEET + r"""SELECT fonte, id, sessao_id, trim(upper(strip_accents(regexp_replace(descricao_raw, '(?i)CPF 529.982.247-25', '')))) AS descricao, doc, confianca, CAST(n AS BIGINT) AS n_origens, evento_status, remetente, nivel, comp,
  list_aggregate(list_sort(ks), 'string_agg', ',') AS evidencias, hora, CAST(indice AS BIGINT) AS indice, nullif(c_historico, '') AS historico, duvida, conf FROM s""")(
    lambda m, p: rows(m, p).select("fonte", "id", "sessao_id", "descricao", F.col("nr_extrato_bancario").alias("doc"), "confianca", "n_origens", "evento_status", F.col("remetente_destinatario").alias("remetente"), "nivel", F.col("comparacao_nome").alias("comp"), F.nullif(F.array_join("evidencias", ","), F.lit("")).alias("evidencias"), "hora", F.col("indice_linha").alias("indice"), F.try_element_at("campos", F.lit("historico")).alias("historico"), F.col("extracao_duvidosa").alias("duvida"), F.col("extracao_confirmada").alias("conf"))
)
query("sheet_status", VIEWS, SHEET + "SELECT fonte, id, estado FROM s")(lambda m, p: rows(m, p).select("fonte", "id", "estado"))
query("sheet_summary", VIEWS, SHEET + """SELECT sessao_id, count(*) AS total, count(*) FILTER (WHERE estado = 'pronta') AS prontas, count(*) FILTER (WHERE nome IS NULL) AS sem_pessoa, count(*) FILTER (WHERE length(coalesce(remetente, '')) < 3) AS sem_remetente, count(*) FILTER (WHERE confianca < 0.6) AS baixa_confianca,
  count(*) FILTER (WHERE estado = 'merge_pendente') AS merge_pendente, count(*) FILTER (WHERE estado = 'extracao_duvidosa') AS extracao_duvidosa, count(*) FILTER (WHERE nivel = 'BAIXA' AND nome IS NULL) AS doc_sem_cadastro, count(*) FILTER (WHERE comp = 'difere') AS nome_diverge,
  count(*) FILTER (WHERE estado = 'pronta') = count(*) AS exportavel FROM s GROUP BY sessao_id""")(lambda m, p: sheet.summary(rows(m, p), "sessao_id"))
_SECONDS = "CASE WHEN hora LIKE '%:%' THEN CAST(split_part(hora, ':', 1) AS INT) * 3600 + CAST(split_part(hora, ':', 2) AS INT) * 60 + CAST(coalesce(nullif(split_part(hora, ':', 3), ''), '0') AS INT) ELSE -1 END"
_KEYS = ("data_movimento", "hora IS NULL", _SECONDS, "coalesce(indice, 9007199254740991)", "coalesce(doc, c_documento, '')", "id")


def _placed(rows: DataFrame, order: str) -> DataFrame:
    return rows.select("fonte", "id", "sessao_id", F.row_number().over(Window.partitionBy("sessao_id").orderBy(*sheet.ordering(order), "fonte")).cast("long").alias("posicao"))


def _orders(m: DataFrame, p: DataFrame) -> DataFrame:
    shown = written(rows(m, p), "sheet")  # six orders of one sheet
    return reduce(DataFrame.union, [_placed(shown, o).select("fonte", "id", F.lit(o).alias("ordenacao"), "posicao") for o in sheet.ORDERS])


query("sheet_order", VIEWS, SHEET + f"SELECT fonte, id, sessao_id, row_number() OVER (PARTITION BY sessao_id ORDER BY {', '.join(_KEYS)}, fonte) AS posicao FROM s")(lambda m, p: _placed(rows(m, p), "cronologico_asc"))
query("sheet_orders", VIEWS, SHEET + " UNION ALL ".join(
    f"SELECT fonte, id, '{o}' AS ordenacao, row_number() OVER (PARTITION BY sessao_id ORDER BY {', '.join(f'{c} {d}' for c in (*first, *_KEYS))}, fonte) AS posicao FROM s" for o, (first, back) in sheet.ORDERS.items() for d in ["DESC" if back else "ASC"]
))(_orders)
query("file_summary", VIEWS, SHEET + f""", of AS (SELECT DISTINCT s.fonte, s.id, s.sessao_id, l.arquivo_id FROM s JOIN k ON s.fonte = 'consolidacao' AND s.id = k.evento_id JOIN l ON k.id = l.id UNION ALL SELECT s.fonte, s.id, s.sessao_id, l.arquivo_id FROM s JOIN l ON s.fonte = 'movimentacao' AND s.id = l.id),
fl AS ({FILES.format(m="movimentacao")}), pg AS ({PAGES.format(m="movimentacao")})
SELECT fl.sessao_id, fl.arquivo_id, (SELECT count(*) FROM vivas WHERE vivas.arquivo_id = fl.arquivo_id) AS movimentacoes, (SELECT count(*) FROM of WHERE of.arquivo_id = fl.arquivo_id AND of.sessao_id = fl.sessao_id) AS linhas_planilha,
  (SELECT count(*) FROM pg WHERE pg.arquivo_id = fl.arquivo_id AND status = 'VERIFICAR') AS paginas_verificar, (SELECT string_agg(pagina || status || aceitas, ';' ORDER BY pagina) FROM pg WHERE pg.arquivo_id = fl.arquivo_id) AS paginas FROM fl""")(
    lambda m, p: sheet.file_summary((c := case(m, p))[0], sheet.origins(c[0], c[2], c[3]), m.sparkSession.sql(PAGES, m=m), m.sparkSession.sql(FILES, m=m)).withColumn("paginas", F.array_join(F.transform("paginas", lambda x: F.concat(x["pagina"], x["status"], x["aceitas"])), ";"))
)
query("session_totals", VIEWS, SHEET + """SELECT sessao_id, coalesce(b, 0) AS movimentacoes_brutas, coalesce(n, 0) AS linhas_planilha, coalesce(q, 0) AS merges_pendentes FROM (SELECT sessao_id, count(*) AS b FROM vivas GROUP BY 1)
FULL JOIN (SELECT sessao_id, count(*) AS n, count(*) FILTER (WHERE estado = 'merge_pendente') AS q FROM s GROUP BY 1) USING (sessao_id)""")(lambda m, p: sheet.session_totals(case(m, p)[0], rows(m, p)))
