"""Registered queries over a model's answers and over the origins of events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import aimatch, provenance
from ledgerloom.plans.registered import query

# The same text runs in Spark and in DuckDB.
LINES = """SELECT id, status, CASE WHEN id % 3 = 0 THEN pessoa_id END AS pessoa_id, confianca, bloqueio_export,
  CASE id % 7 WHEN 0 THEN 'Pgto Customer#0000000' || lpad(CAST(id % 90 AS VARCHAR(2)), 2, '0') || ' ref' WHEN 1 THEN 'de a Supplier#000000003  Nowhere x Customer#000000004 Supplier' WHEN 2 THEN 'ab c' WHEN 3 THEN NULL WHEN 4 THEN 'doc 529.982.247-25 customer' WHEN 5 THEN '#000 0000 pgto' ELSE 'CNPJ 00.000.000/0000-0' || CAST(id % 9 AS VARCHAR(1)) || ' ok' END AS descricao_raw FROM {m}"""
ANSWERS = """SELECT id AS movimentacao_id, id % 2 = 0 AS mesmo_evento, CASE WHEN id % 6 <> 4 THEN CAST(id % 13 AS DOUBLE) / CAST(10 AS DOUBLE) END AS confianca, CASE WHEN id % 4 <> 1 THEN 'porque' END AS justificativa,
  CASE id % 5 WHEN 0 THEN 'PF' WHEN 1 THEN 'PJ' WHEN 2 THEN 'PF' END AS pessoa_tipo, CASE id % 5 WHEN 0 THEN '000.000.001-91' WHEN 1 THEN lpad(CAST(id % 12 AS VARCHAR(14)), 14, '0') WHEN 2 THEN '52998224724' WHEN 3 THEN '1' END AS pessoa_documento, id % 4 = 0 AS com_lacuna, id % 8 = 3 AS com_conflito FROM {m} WHERE id % 9 <> 5"""
CLASSES = "SELECT id AS movimentacao_id, CASE WHEN id % 3 <> 0 THEN 'OR' END AS fonte_recurso, CASE WHEN id % 4 = 0 THEN '' ELSE '0' END AS natureza_recurso, 'PF' AS tipo_origem_recurso FROM {m} WHERE id % 5 <> 0"
PEOPLE = "SELECT pessoa_id, tipo, CASE WHEN tipo = 'PF' AND pessoa_id = 5 THEN '00000000191' ELSE documento END AS documento, nome FROM {p}"


def case(m: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines, registry, classifications and answers of the fixture."""
    spark = m.sparkSession
    lines = spark.sql(LINES, m=m).withColumn("pessoa", F.when(F.col("pessoa_id").isNotNull(), F.struct(F.lit("PF").alias("tipo"), F.col("pessoa_id").cast("long").alias("id")))).drop("pessoa_id")
    answers = spark.sql(ANSWERS, m=m)
    gaps = F.when(F.col("com_lacuna"), F.array(F.lit("natureza_recurso"), F.lit("cargo")))
    proofs = F.when(F.col("com_conflito"), F.array(F.struct(F.lit("CONFLITO_NOME").alias("tipo"), F.lit("dois").alias("detalhe"))))
    return lines, spark.sql(PEOPLE, p=p), spark.sql(CLASSES, m=m), answers.withColumns({"campos_faltantes": gaps, "evidencias": proofs}).drop("com_lacuna", "com_conflito")


# Candidates as cand (id, ordem, tipo, documento, nome): documents of the fixture's texts, then the words' people.
PROBE = f""", l AS ({LINES.format(m="movimentacao")}), q AS ({PEOPLE.format(p="pessoa")}),
w AS (SELECT id, unnest(ws) AS palavra, generate_subscripts(ws, 1) AS em FROM (SELECT id, list_filter(regexp_split_to_array(coalesce(descricao_raw, ''), '\\s+'), lambda t: length(t) >= 4)[:3] AS ws FROM l)),
h AS (SELECT palavra, q.*, row_number() OVER (PARTITION BY palavra, tipo ORDER BY pessoa_id) AS k FROM (SELECT DISTINCT palavra FROM w) JOIN q ON contains(nome, palavra) QUALIFY k <= 3),
dc AS (SELECT id, CASE WHEN id % 7 = 4 THEN 'PF' ELSE 'PJ' END AS tipo, CASE WHEN id % 7 = 4 THEN '52998224725' ELSE '0000000000000' || CAST(id % 9 AS VARCHAR) END AS documento FROM l WHERE id % 7 IN (4, 6)),
al AS (SELECT dc.id, 0 AS a, 0 AS b, '' AS c, 0 AS d, dc.tipo, dc.documento, coalesce(q.nome, 'Cadastro pendente') AS nome FROM dc LEFT JOIN q ON q.tipo = dc.tipo AND q.documento = dc.documento
  UNION ALL SELECT w.id, 1, em, h.tipo, k, h.tipo, documento, nome FROM w JOIN h USING (palavra)),
cand AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a, b, c, d) AS INT) AS ordem, tipo, documento, nome FROM (SELECT *, row_number() OVER (PARTITION BY id, tipo, documento ORDER BY a, b, c, d) AS u FROM al) WHERE u = 1)
"""
query("registry_probe", "movimentacao pessoa", PROBE + "SELECT * FROM cand")(lambda m, p: aimatch.candidates((c := case(m, p))[0], c[1]))

ANSWERED = PROBE + f""", an AS ({ANSWERS.format(m="movimentacao")}), cl AS ({CLASSES.format(m="movimentacao")}),
b AS (SELECT l.*, EXISTS (SELECT 1 FROM cand WHERE cand.id = l.id) AS perguntada, an.* EXCLUDE (movimentacao_id, confianca), an.confianca AS certeza, cl.movimentacao_id IS NULL OR coalesce(fonte_recurso, '') = '' AS g1, cl.movimentacao_id IS NULL OR coalesce(natureza_recurso, '') = '' AS g2, cl.movimentacao_id IS NULL AS g3
  FROM l LEFT JOIN an ON l.id = an.movimentacao_id LEFT JOIN cl ON l.id = cl.movimentacao_id WHERE status NOT IN ('CONFIRMADO', 'EXPORTADO')),
r AS (SELECT *, perguntada AND certeza IS NOT NULL AS resposta FROM b),
pr AS (SELECT id, 'IA_MESMO_EVENTO' AS tipo, least(1, certeza) AS peso, CASE WHEN mesmo_evento THEN 'mesmo evento' ELSE 'evento incerto' END AS detalhe FROM r WHERE resposta UNION ALL SELECT id, 'IA_JUSTIFICATIVA', 0, coalesce(justificativa, '') FROM r WHERE resposta
  UNION ALL SELECT id, 'CONFLITO_NOME', 0, 'dois' FROM r WHERE resposta AND com_conflito UNION ALL SELECT id, 'LACUNA_XSD', 0, 'cargo' FROM r WHERE resposta AND com_lacuna UNION ALL SELECT id, 'IA_INDISPONIVEL', 0, 'OpenRouter indisponível' FROM r WHERE perguntada AND NOT resposta
  UNION ALL SELECT id, 'DOCUMENTO_INVALIDO', 0, 'Documento inválido: ' || pessoa_documento FROM r WHERE resposta AND id % 5 = 2
  UNION ALL SELECT id, 'LACUNA_XSD', 0, 'fonte_recurso' FROM r WHERE g1 UNION ALL SELECT id, 'LACUNA_XSD', 0, 'natureza_recurso' FROM r WHERE g2 OR (resposta AND com_lacuna) UNION ALL SELECT id, 'LACUNA_XSD', 0, 'tipo_origem_recurso' FROM r WHERE g3)
"""
query("ai_match_lines", "movimentacao pessoa", ANSWERED + """, nq AS (SELECT r.id, q.tipo, q.pessoa_id FROM r JOIN q ON resposta AND q.tipo = r.pessoa_tipo AND q.documento = CASE id % 5 WHEN 0 THEN '00000000191' WHEN 1 THEN pessoa_documento END)
SELECT r.id, CASE WHEN nq.id IS NOT NULL THEN nq.tipo WHEN r.pessoa_id IS NOT NULL THEN 'PF' END AS tipo, CAST(coalesce(nq.pessoa_id, r.pessoa_id) AS BIGINT) AS pessoa, CASE WHEN resposta THEN CASE WHEN com_conflito THEN least(0.4, certeza) ELSE least(1, certeza) END ELSE CAST(0 AS DOUBLE) END AS confianca,
  true AS bloqueio_export, CASE WHEN resposta THEN 'PENDENTE_REVISAO' ELSE 'RASCUNHO' END AS status FROM r LEFT JOIN nq ON r.id = nq.id
UNION ALL SELECT id, CASE WHEN pessoa_id IS NOT NULL THEN 'PF' END, CAST(pessoa_id AS BIGINT), confianca, bloqueio_export, status FROM l WHERE status IN ('CONFIRMADO', 'EXPORTADO')""")(
    lambda m, p: _answered(m, p)[0].select("id", "pessoa.tipo", F.col("pessoa.id").alias("pessoa"), "confianca", "bloqueio_export", "status")
)
query("ai_match_evidence", "movimentacao pessoa", ANSWERED + "SELECT id AS movimentacao_id, tipo, CAST(peso AS DOUBLE) AS peso, detalhe FROM pr UNION ALL SELECT id, 'IA', 0.15, 'velha' FROM l WHERE status IN ('CONFIRMADO', 'EXPORTADO')")(lambda m, p: _answered(m, p)[1])


def _answered(m: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines, people, classes, answers = case(m, p)
    old = lines.select(F.col("id").alias("movimentacao_id"), F.lit("IA").alias("tipo"), F.lit(0.15).alias("peso"), F.lit("velha").alias("detalhe"))
    return aimatch.apply_answers(lines, old, people, classes, answers)


ORIGINS = """SELECT id, CASE WHEN id % 4 = 1 THEN '52998224725' END AS cpf, id % 5 <> 0 AS com_origem, arquivo_id, 'a' || CAST(arquivo_id AS VARCHAR(9)) AS nome_arquivo, CAST(id % 6 + 1 AS INT) AS pagina, CAST(id % 40 AS INT) AS indice_linha, id % 3 = 0 AS com_caixa,
  CASE WHEN id % 7 = 0 THEN '11222333000181' END AS cnpj, id % 11 < 5 AS com_campos FROM {m}"""
EVENTS = """SELECT id AS evento_id, CASE id % 8 WHEN 0 THEN 'Mesmo CPF nas duas linhas' WHEN 1 THEN 'CPF no extrato completo com nome alinhado ao cadastro' WHEN 2 THEN 'Nome único no cadastro' WHEN 3 THEN 'descrição equivalente' WHEN 4 THEN 'CPF na linha' WHEN 5 THEN NULL ELSE 'Mesma data' END AS justificativa,
  CAST(id % 21 * 5 AS DOUBLE) / CAST(100 AS DOUBLE) AS confianca, CASE WHEN id % 3 = 1 THEN pessoa_id END AS pessoa_id FROM {m} WHERE id % 4 <> 3"""
MEMBERS = "SELECT e.id AS evento_id, k.posicao, m.id FROM {m} e, (SELECT 0 AS posicao UNION ALL SELECT 1 UNION ALL SELECT 2) k, {m} m WHERE e.id % 4 <> 3 AND m.id = e.id + 2 - k.posicao AND k.posicao < e.id % 4 + 1 AND e.id % 9 <> 0"


def _origins(m: DataFrame) -> DataFrame:
    spark = m.sparkSession
    box = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.5).alias("y"), F.lit(0.1).alias("w"), F.lit(0.02).alias("h"))
    fields = F.create_map(F.lit("valor"), F.struct((F.col("pagina") + 1).alias("pagina"), F.lit(7).alias("indice_linha"), box(0.9).alias("bbox")), F.lit("cpf"), F.struct("pagina", F.lit(8).alias("indice_linha"), F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("bbox")))
    origin = F.struct("arquivo_id", "nome_arquivo", "pagina", "indice_linha", F.when(F.col("com_caixa"), box(0.1)).alias("bbox"), F.lit(None).cast("string").alias("cpf"), "cnpj", F.when(F.col("com_campos"), fields).alias("campos"))
    lines = spark.sql(ORIGINS, m=m).select("id", "cpf", F.when(F.col("com_origem"), origin).alias("origem"))
    events = spark.sql(EVENTS, m=m).withColumn("pessoa", F.when(F.col("pessoa_id").isNotNull(), F.struct(F.lit("PF").alias("tipo"), F.col("pessoa_id").cast("long").alias("id"))))
    return provenance.event_origins(events, spark.sql(MEMBERS, m=m), lines)


def _told(origins: DataFrame) -> DataFrame:
    """A row for each reference, after a way through JSON."""
    rows = provenance.reference_rows(provenance.read_back(provenance.references_json(origins)))
    return rows.select("evento_id", "atributo", "posicao", "r.tipo", "r.movimentacao_id", "r.arquivo_id", "r.nome_arquivo", "r.pagina", "r.indice_linha", F.col("r.bbox.x").alias("x"), "r.campo", F.col("r.pessoa.id").alias("pessoa"), "r.match_tipo", F.array_join("r.movimentacao_ids", ",").alias("ids"), "r.regra", "r.detalhe", "r.motivo")


_NONE = "NULL, NULL, NULL, NULL, NULL, NULL, NULL"
_PAGE = "id, arquivo_id, nome_arquivo, {pagina}, {indice}, {x}, '{campo}'"
_FIELD = {"valor": ("CASE WHEN com_campos THEN pagina + 1 ELSE pagina END", "CASE WHEN com_campos THEN 7 ELSE indice_linha END", "CASE WHEN com_campos THEN 0.9 WHEN com_caixa THEN 0.1 END"), "cpf": ("pagina", "CASE WHEN com_campos THEN 8 ELSE indice_linha END", "CASE WHEN com_caixa THEN 0.1 END")}


def _page_sql(campo: str) -> str:
    pagina, indice, x = _FIELD.get(campo, ("pagina", "indice_linha", "CASE WHEN com_caixa THEN 0.1 END"))
    return _PAGE.format(pagina=pagina, indice=indice, x=x, campo=campo)


_RULE = "CASE " + " ".join(f"WHEN contains(j, '{says}') THEN '{rule}'" for says, rule in provenance.RULES) + f" ELSE '{provenance.OTHER_RULE}' END"
_EACH = " UNION ALL ".join(
    f"SELECT evento_id, '{a}', em, 'PDF', {_page_sql(campo)}, NULL, NULL, NULL, NULL, NULL, NULL FROM x WHERE com_origem UNION ALL SELECT evento_id, '{a}', em, 'INDISPONIVEL', {_NONE}, NULL, NULL, NULL, NULL, NULL, 'ingestao_anterior' FROM x WHERE NOT com_origem"
    for a, campo in (("data_movimento", "data"), ("valor", "valor"), ("direcao", "direcao"))
)
query("event_origins", "movimentacao", f""", o AS ({ORIGINS.format(m="movimentacao")}), e AS (SELECT *, coalesce(justificativa, '') AS j FROM ({EVENTS.format(m="movimentacao")})), k AS ({MEMBERS.format(m="movimentacao")}),
x AS (SELECT k.*, o.* EXCLUDE (id), row_number() OVER (PARTITION BY evento_id ORDER BY posicao) - 1 AS em FROM k JOIN o ON k.id = o.id), n AS (SELECT e.*, coalesce(c, 0) AS c, ids FROM e LEFT JOIN (SELECT evento_id, count(*) AS c, string_agg(CAST(id AS VARCHAR), ',' ORDER BY posicao) AS ids FROM x GROUP BY 1) USING (evento_id)),
fd AS (SELECT evento_id, arg_min(id, em) AS id FROM x WHERE cpf IS NOT NULL OR (com_origem AND cnpj IS NOT NULL) GROUP BY 1),
pe AS (SELECT evento_id, 0 AS s, 'CRUZAMENTO_PDF' AS tipo, {_NONE}, NULL AS pessoa, NULL AS m, ids, {_RULE} AS regra, j AS detalhe, NULL AS motivo FROM n WHERE c >= 2
  UNION ALL SELECT x.evento_id, 1, 'PDF', x.{_page_sql("cpf")}, NULL, NULL, NULL, NULL, NULL, NULL FROM x JOIN n USING (evento_id) LEFT JOIN fd ON fd.evento_id = x.evento_id WHERE com_origem AND (c = 1 OR (c >= 2 AND fd.id = x.id))
  UNION ALL SELECT x.evento_id, 1, 'INDISPONIVEL', {_NONE}, NULL, NULL, NULL, NULL, NULL, 'ingestao_anterior' FROM x JOIN n USING (evento_id) WHERE NOT com_origem AND c = 1
  UNION ALL SELECT evento_id, 2, 'CADASTRO_UF', {_NONE}, pessoa_id, CASE WHEN contains(j, 'Nome único') OR contains(j, 'nome alinhado') THEN 'NOME_CADASTRO' ELSE 'CPF_CADASTRO' END, NULL, NULL, NULL, NULL FROM n WHERE pessoa_id IS NOT NULL
  UNION ALL SELECT evento_id, 3, 'INDISPONIVEL', {_NONE}, NULL, NULL, NULL, NULL, NULL, 'sem_vinculo' FROM n WHERE pessoa_id IS NULL AND c = 0),
t(evento_id, atributo, posicao, tipo, movimentacao_id, arquivo_id, nome_arquivo, pagina, indice_linha, x, campo, pessoa, match_tipo, ids, regra, detalhe, motivo) AS ({_EACH}
  UNION ALL SELECT evento_id, 'pessoa', row_number() OVER (PARTITION BY evento_id ORDER BY s) - 1, * EXCLUDE (evento_id, s) FROM pe
  UNION ALL SELECT evento_id, 'confianca', 0, 'CRUZAMENTO_PDF', {_NONE}, NULL, NULL, coalesce(ids, ''), {_RULE}, CASE WHEN c >= 2 THEN j ELSE 'confianca=' || CASE WHEN confianca = floor(confianca) THEN CAST(CAST(confianca AS INT) AS VARCHAR) ELSE CAST(confianca AS VARCHAR) END END, NULL FROM n)
SELECT evento_id, atributo, CAST(posicao AS INT) AS posicao, tipo, CAST(movimentacao_id AS BIGINT) AS movimentacao_id, CAST(arquivo_id AS BIGINT) AS arquivo_id, nome_arquivo, CAST(pagina AS INT) AS pagina, CAST(indice_linha AS INT) AS indice_linha, CAST(x AS DOUBLE) AS x, campo, CAST(pessoa AS BIGINT) AS pessoa, match_tipo, ids, regra, detalhe, motivo FROM t""")(
    lambda m: _told(_origins(m))
)
