"""Registered queries over matches with the registry and approvals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import approval
from ledgerloom.operators.storage import written
from ledgerloom.plans.registered import query

# Lines with documents and counterparties; the same text runs in Spark and in DuckDB.
LINES = """SELECT id, uf, exercicio, CASE WHEN id % 8 = 5 THEN 'RASCUNHO' ELSE status END AS status, CASE WHEN pessoa_id IS NOT NULL AND id % 3 <> 1 THEN 'PF' END AS tipo,
  CASE WHEN pessoa_id IS NOT NULL AND id % 3 <> 1 THEN pessoa_id END AS pessoa, CASE WHEN id % 44 = 0 THEN '99999999999' WHEN id % 4 = 0 THEN lpad(CAST(id % 60 + 1 AS VARCHAR(11)), 11, '0') END AS cpf,
  CASE WHEN id % 9 = 1 THEN lpad(CAST(id % 8 + 1 AS VARCHAR(14)), 14, '0') END AS cnpj,
  CASE id % 7 WHEN 0 THEN 'Customer#00000000' || CAST(id % 5 + 1 AS VARCHAR(2)) WHEN 1 THEN ' ab ' WHEN 2 THEN NULL WHEN 3 THEN 'supplier#000000001' WHEN 4 THEN 'Nobody Here' ELSE 'customer' END AS remetente_destinatario,
  CASE WHEN id % 6 = 0 THEN ' ' ELSE descricao_raw END AS descricao_raw, confianca, bloqueio_export, canonica_id FROM {m}"""
PEOPLE = "SELECT pessoa_id, tipo, documento, CASE WHEN tipo = 'PF' AND pessoa_id % 7 = 0 THEN ' Desconhecido ' WHEN tipo = 'PJ' AND pessoa_id % 4 = 0 THEN 'DESCONHECIDA' ELSE nome END AS nome FROM {p}"
EVIDENCE = "SELECT id AS movimentacao_id, CASE WHEN id % 2 = 0 THEN 'VALOR_DATA' ELSE 'IA' END AS tipo, CAST(0.25 AS DOUBLE) AS peso FROM {m} WHERE id % 5 <> 0"
CLASSES = "SELECT id AS movimentacao_id, 'OR' AS fonte_recurso, CASE WHEN id % 3 = 0 THEN '' ELSE '0' END AS natureza_recurso, 'PF' AS tipo_origem_recurso FROM {m} WHERE id % 2 = 0"
HIGH = 0.4


def case(m: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, evidence and registry of the fixture."""
    spark = m.sparkSession
    lines = spark.sql(LINES, m=m).withColumn("pessoa", F.when(F.col("tipo").isNotNull(), F.struct("tipo", F.col("pessoa").cast("long").alias("id")))).drop("tipo")
    return lines, spark.sql(EVIDENCE, m=m), spark.sql(PEOPLE, p=p)


def told(lines: DataFrame, evidence: DataFrame, *more: str) -> DataFrame:
    """Lines with their evidence as one text, and more of their columns."""
    proofs = evidence.groupBy(F.col("movimentacao_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "tipo", F.round(F.col("peso") * 10000).cast("long").cast("string")))), ",").alias("evidencias"))
    return lines.join(proofs, "id", "left").select("id", "pessoa.tipo", F.col("pessoa.id").alias("pessoa"), "confianca", "bloqueio_export", "status", F.coalesce("evidencias", F.lit("")).alias("evidencias"), *more)


_NORMAL = "trim(upper({0}))"
# The registry's verdict for every line, by the rule cascade; the fixture's names agree only by one holding the other.
VERDICT = f""", l AS ({LINES.format(m="movimentacao")}), q AS ({PEOPLE.format(p="pessoa")}), ev AS ({EVIDENCE.format(m="movimentacao")}), cl AS ({CLASSES.format(m="movimentacao")}),
nm AS (SELECT DISTINCT remetente_destinatario AS dito, {_NORMAL.format("remetente_destinatario")} AS n FROM l WHERE length(trim(remetente_destinatario)) >= 3),
ag AS (SELECT dito, count(*) AS quantos, min(q.tipo) AS tipo, min(q.pessoa_id) AS pessoa FROM nm JOIN q ON length(n) > 3 AND length({_NORMAL.format("nome")}) > 3 AND (contains(n, {_NORMAL.format("nome")}) OR contains({_NORMAL.format("nome")}, n)) GROUP BY dito),
v AS (SELECT l.id, CASE WHEN l.cpf IS NOT NULL AND l.cnpj IS NOT NULL THEN 'CONFLITO_DOCUMENTO:0' WHEN l.cpf IS NOT NULL AND pf.pessoa_id IS NULL THEN 'CPF_SEM_CADASTRO:0' WHEN l.cnpj IS NOT NULL AND pj.pessoa_id IS NULL THEN 'CNPJ_SEM_CADASTRO:0'
    WHEN l.cpf IS NOT NULL THEN 'CPF_CADASTRO:4500' || CASE WHEN difere THEN ',NOME_DIVERGE_CADASTRO:0' ELSE '' END WHEN l.cnpj IS NOT NULL THEN 'CNPJ_CADASTRO:4500' || CASE WHEN difere THEN ',NOME_DIVERGE_CADASTRO:0' ELSE '' END
    WHEN quantos = 1 THEN 'NOME_CADASTRO:3825' WHEN quantos > 1 THEN 'CONFLITO_NOME:0' ELSE '' END AS novas,
  CASE WHEN l.cpf IS NOT NULL AND l.cnpj IS NOT NULL THEN NULL WHEN l.cpf IS NOT NULL THEN pf.pessoa_id WHEN l.cnpj IS NOT NULL THEN pj.pessoa_id WHEN quantos = 1 THEN ag.pessoa END AS nova,
  CASE WHEN l.cpf IS NOT NULL AND l.cnpj IS NOT NULL THEN NULL WHEN l.cpf IS NOT NULL THEN pf.tipo WHEN l.cnpj IS NOT NULL THEN pj.tipo WHEN quantos = 1 THEN ag.tipo END AS novo_tipo, bate
  FROM (SELECT l.*, pf.pessoa_id AS a, pj.pessoa_id AS b, coalesce(pf.nome, pj.nome) AS achado FROM l LEFT JOIN q pf ON pf.tipo = 'PF' AND l.cpf = pf.documento LEFT JOIN q pj ON pj.tipo = 'PJ' AND l.cnpj = pj.documento) l
  LEFT JOIN q pf ON pf.tipo = 'PF' AND l.cpf = pf.documento LEFT JOIN q pj ON pj.tipo = 'PJ' AND l.cnpj = pj.documento LEFT JOIN ag ON l.remetente_destinatario = ag.dito,
  LATERAL (SELECT length(trim(l.remetente_destinatario)) > 3 AND (contains({_NORMAL.format("l.remetente_destinatario")}, {_NORMAL.format("l.achado")}) OR contains({_NORMAL.format("l.achado")}, {_NORMAL.format("l.remetente_destinatario")})) AS bate) x,
  LATERAL (SELECT length(trim(l.remetente_destinatario)) > 3 AND NOT x.bate AS difere) y),
s AS (SELECT v.*, CASE WHEN novas LIKE '%NOME_CADASTRO%' THEN 0.3825 WHEN nova IS NOT NULL THEN 0.45 ELSE 0 END AS nota FROM v),
velhas AS (SELECT movimentacao_id, string_agg(tipo || ':' || CAST(CAST(round(peso * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY tipo) AS e FROM ev GROUP BY 1)
"""
query("deterministic_match", "movimentacao pessoa", VERDICT + f"""
SELECT l.id, novo_tipo AS tipo, CAST(nova AS BIGINT) AS pessoa, CAST(nota AS DOUBLE) AS confianca, coalesce(cl.natureza_recurso, '') = '' AS bloqueio_export,
  CASE WHEN novas LIKE '%_CADASTRO:4500%' AND bate AND nota >= {HIGH} AND NOT coalesce(cl.natureza_recurso, '') = '' THEN 'CONFIRMADO' ELSE 'PENDENTE_REVISAO' END AS status, novas AS evidencias
FROM l JOIN s ON l.id = s.id LEFT JOIN cl ON l.id = cl.movimentacao_id""")(
    lambda m, p: told(*approval.deterministic_match(*case(m, p), classes=m.sparkSession.sql(CLASSES, m=m), high=HIGH))
)
query("rematch_pending", "movimentacao pessoa", VERDICT + f""", r AS (SELECT l.id, l.status IN ('RASCUNHO', 'PENDENTE_REVISAO') AND (cpf IS NOT NULL OR cnpj IS NOT NULL OR length(trim(coalesce(remetente_destinatario, ''))) >= 3)
  AND (l.pessoa IS NULL OR {_NORMAL.format("q.nome")} = 'DESCONHECIDO') AND uf < 3 AS vai FROM l LEFT JOIN q ON q.tipo = 'PF' AND l.pessoa = q.pessoa_id)
SELECT l.id, CASE WHEN vai THEN novo_tipo ELSE l.tipo END AS tipo, CAST(CASE WHEN vai THEN nova ELSE l.pessoa END AS BIGINT) AS pessoa, CASE WHEN vai THEN CAST(nota AS DOUBLE) ELSE confianca END AS confianca, vai OR bloqueio_export AS bloqueio_export,
  CASE WHEN vai THEN 'PENDENTE_REVISAO' ELSE status END AS status, CASE WHEN vai THEN novas ELSE coalesce(e, '') END AS evidencias
FROM l JOIN s ON l.id = s.id JOIN r ON l.id = r.id LEFT JOIN velhas ON l.id = velhas.movimentacao_id""")(
    lambda m, p: told(*approval.rematch_pending(*(c := case(m, p)), scope=c[0].where("uf < 3")))
)

def events_of(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, their lines and decisions: three families of events that share lines, within a state and year."""
    scope = lines.select("id", "uf", "exercicio")
    heads = [scope.where("id % 3 = 0").selectExpr("id evento_id", "id _head", "array(0, 1, 2) _d", "uf", "exercicio"), scope.where("id % 5 = 0").selectExpr("-id evento_id", "id _head", "array(7, 0) _d", "uf", "exercicio"), scope.where("id % 4 = 0").selectExpr("-1000000000 - id evento_id", "id _head", "array(0, 4, 9) _d", "uf", "exercicio")]
    all_of = heads[0].unionByName(heads[1]).unionByName(heads[2])
    members = all_of.select("evento_id", "uf", "exercicio", F.posexplode("_d").alias("posicao", "_k"), "_head").withColumn("id", F.col("_head") + F.col("_k")).join(scope, ["id", "uf", "exercicio"], "left_semi")
    role = F.element_at(F.array(F.lit("PIX"), F.lit("COMPLETO"), F.lit("OUTRO")), (F.pmod(F.col("id") * 31 + F.col("evento_id"), F.lit(3)) + 1).cast("int"))
    event_lines = members.select("evento_id", "posicao", "id", role.alias("papel"))
    k = F.abs("evento_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("Customer#00000000"), (k % 6 + 1).cast("string"))).when(k % 4 == 1, "Nobody Here").when(k % 4 == 2, "supplier#000000001")
    events = all_of.select("evento_id", "uf", "exercicio", F.when(k % 13 == 0, "APROVADO").otherwise("PENDENTE").alias("status"), name.alias("remetente_destinatario"), ((k * 37 % 100).cast("double") / 100).alias("confianca"), F.lit(None).cast("long").alias("canonica_id"))
    place = F.when(F.col("evento_id") > 0, 0).when(F.col("evento_id") > -1000000000, 1).otherwise(2) + (k % 1000000000) * 7919 % 1000003 * 3
    first = all_of.select("evento_id", place.alias("ordem"), F.when(k % 7 == 0, "REJEITAR").otherwise("APROVAR").alias("decisao"))
    again = first.where("evento_id % 10 = 0").select("evento_id", (F.col("ordem") + 4000000).alias("ordem"), F.when(k % 20 == 0, "REJEITAR").otherwise("APROVAR").alias("decisao"))
    nobody = first.where("evento_id % 300 = 0").select((F.col("evento_id") + 5000000000).alias("evento_id"), (F.col("ordem") + 8000000).alias("ordem"), F.lit("APROVAR").alias("decisao"))
    return events, event_lines, first.unionByName(again).unionByName(nobody)


def _cascade(m: DataFrame, p: DataFrame) -> dict[str, DataFrame]:
    """The fixture's tables, each written once, as an approval reads them several times."""
    lines, evidence, people = case(m, p)
    lines = written(lines, "lines")
    events, event_lines, decisions = (written(d, n) for d, n in zip(events_of(lines), ("events", "event_lines", "decisions")))
    return approval.approve(lines, evidence, events, event_lines, people, decisions)


def _decisions(m: DataFrame, p: DataFrame) -> DataFrame:
    """What each decision meets depends on events and decisions alone."""
    events, _, decisions = events_of(case(m, p)[0])
    return approval.decided(events, decisions)


def _final_lines(m: DataFrame, p: DataFrame) -> DataFrame:
    done = _cascade(m, p)
    return told(done["linhas"], done["evidencias"], "canonica_id", "remetente_destinatario", "descricao_raw")


query("approval_lines", "movimentacao pessoa")(_final_lines)
query("approval_decisions", "movimentacao pessoa")(_decisions)
