"""Registered queries over changes of the registry and the store of events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import events, people
from ledgerloom.operators.storage import fresh_path
from ledgerloom.plans.registered import query

# The same text runs in Spark and in DuckDB.
PEOPLE = "SELECT tipo, pessoa_id, nome, CASE WHEN tipo = 'PF' AND pessoa_id % 3 = 0 THEN 'T' || CAST(pessoa_id % 4 AS VARCHAR(3)) END AS titulo_eleitor, pessoa_id % 9 = 0 AS deletado, pessoa_id % 4 = 0 AS com_alias FROM {p}"
UPDATES = """SELECT tipo, pessoa_id, 1 AS ordem, CASE pessoa_id % 7 WHEN 0 THEN 'n' WHEN 1 THEN 't' WHEN 2 THEN 'a' WHEN 3 THEN 'nt' WHEN 4 THEN 'na' WHEN 5 THEN '' END AS pedido, CASE WHEN pessoa_id % 5 = 0 THEN ' ' WHEN pessoa_id % 5 = 1 THEN nome ELSE 'Nova  Pessoa é ' || CAST(pessoa_id % 6 AS VARCHAR(3)) END AS nome,
  CASE WHEN pessoa_id % 2 = 0 THEN ' T' || CAST(pessoa_id % 4 AS VARCHAR(3)) ELSE ' ' END AS titulo, pessoa_id % 4 < 2 AS com_alias FROM {p} WHERE pessoa_id % 7 <> 6 UNION ALL SELECT tipo, pessoa_id + 1000000000, 1, 'n', 'X', 'Y', false FROM {p} WHERE pessoa_id % 20 = 0 UNION ALL SELECT tipo, pessoa_id, 2, 'n', 'Tarde', 'Z', false FROM {p} WHERE pessoa_id % 7 = 0"""
ALIAS = "O Outro"


def _people(p: DataFrame) -> DataFrame:
    return p.sparkSession.sql(PEOPLE, p=p).withColumn("aliases", F.when(F.col("com_alias"), F.array(F.lit(ALIAS)))).drop("com_alias")


def _updated(p: DataFrame) -> DataFrame:
    asked = p.sparkSession.sql(UPDATES, p=p)
    fields = F.array_compact(F.array(*[F.when(F.col("pedido").contains(k), name) for k, name in (("n", "nome"), ("t", "titulo_eleitor"), ("a", "aliases"))]))
    asked = asked.select("tipo", "pessoa_id", "ordem", F.when(F.col("pedido") != "", fields).alias("campos"), "nome", F.col("titulo").alias("titulo_eleitor"), F.when(F.col("com_alias"), F.array(F.lit(ALIAS))).alias("aliases"))
    new, outcome = people.update_people(_people(p), asked)
    flat = new.select("tipo", "pessoa_id", "nome", "titulo_eleitor", F.array_join("aliases", ",").alias("aliases"))
    return flat.join(outcome, ["tipo", "pessoa_id"], "full")


query("people_update", "pessoa", f"""
, q AS ({PEOPLE.format(p="pessoa")}), u AS ({UPDATES.format(p="pessoa")}),
r AS (SELECT coalesce(q.tipo, u.tipo) AS tipo, coalesce(q.pessoa_id, u.pessoa_id) AS pessoa_id, q.nome, q.titulo_eleitor, q.com_alias, q.deletado, u.pedido, regexp_replace(trim(upper(strip_accents(u.nome))), '\\s+', ' ', 'g') AS nn, nullif(trim(titulo), '') AS nt, u.com_alias AS na FROM q FULL JOIN (SELECT * FROM u WHERE ordem = 1) u ON q.tipo = u.tipo AND q.pessoa_id = u.pessoa_id),
s AS (SELECT *, CASE WHEN pedido IS NULL THEN NULL WHEN pedido = '' THEN 'i' WHEN deletado IS NULL OR deletado THEN 'f' WHEN contains(pedido, 'n') AND nn = '' THEN 'i' WHEN contains(pedido, 't') AND tipo = 'PJ' THEN 'i'
  WHEN (NOT contains(pedido, 'n') OR nome IS NOT DISTINCT FROM nn) AND (NOT contains(pedido, 't') OR titulo_eleitor IS NOT DISTINCT FROM nt) AND (NOT contains(pedido, 'a') OR com_alias = na) THEN '=' ELSE '!' END AS z FROM r)
SELECT tipo, pessoa_id, CASE WHEN z = '!' AND contains(pedido, 'n') THEN nn ELSE nome END AS nome, CASE WHEN z = '!' AND contains(pedido, 't') THEN nt ELSE titulo_eleitor END AS titulo_eleitor, CASE WHEN (CASE WHEN z = '!' AND contains(pedido, 'a') THEN na ELSE com_alias END) THEN '{ALIAS}' END AS aliases,
  CASE z WHEN 'i' THEN '{people.INVALID}' WHEN 'f' THEN '{people.NOT_FOUND}' WHEN '=' THEN 'igual' WHEN '!' THEN 'atualizada' END AS resultado FROM s""")(_updated)
query("people_delete", "pessoa", f"""
, q AS ({PEOPLE.format(p="pessoa")}), a AS (SELECT tipo, pessoa_id FROM q WHERE pessoa_id % 2 = 0 UNION SELECT tipo, pessoa_id + 1000000000 FROM q WHERE pessoa_id % 20 = 0)
SELECT coalesce(q.tipo, a.tipo) AS tipo, coalesce(q.pessoa_id, a.pessoa_id) AS pessoa_id, CASE WHEN q.tipo IS NOT NULL THEN deletado OR a.tipo IS NOT NULL END AS deletado, CASE WHEN a.tipo IS NULL THEN NULL WHEN q.tipo IS NULL THEN '{people.NOT_FOUND}' WHEN deletado THEN '{people.GONE}' ELSE 'excluida' END AS resultado
FROM q FULL JOIN a ON q.tipo = a.tipo AND q.pessoa_id = a.pessoa_id""")(
    lambda p: (done := people.delete_people(_people(p), _leaving(p)))[0].select("tipo", "pessoa_id", "deletado").join(done[1], ["tipo", "pessoa_id"], "full")
)


def _leaving(p: DataFrame) -> DataFrame:
    twice = p.where("pessoa_id % 2 = 0").select("tipo", "pessoa_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordem"))
    return twice.unionByName(p.where("pessoa_id % 20 = 0").select("tipo", (F.col("pessoa_id") + 1000000000).alias("pessoa_id"), F.lit(1).alias("ordem")))


def _merged(p: DataFrame, m: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Chains of four people of each six: 1 to 2 to 3 to 4, where they exist."""
    merges = p.where("pessoa_id % 6 IN (1, 2, 3)").select("tipo", F.col("pessoa_id").alias("de"), (F.col("pessoa_id") + 1).alias("para"), F.lit(1).alias("ordem"))
    late = p.where("pessoa_id % 6 = 1").select("tipo", F.col("pessoa_id").alias("de"), F.lit(6).cast("long").alias("para"), F.lit(2).alias("ordem"))
    refs = m.select("id", F.when(F.col("pessoa_id").isNotNull(), F.struct(F.when(F.col("id") % 3 == 0, "PJ").otherwise("PF").alias("tipo"), F.col("pessoa_id").cast("long").alias("id"))).alias("pessoa"))
    return people.merge_people(_people(p), merges.unionByName(late), {"linhas": (refs, "pessoa")})


_END = "CASE WHEN pessoa_id % 6 IN (1, 2, 3) THEN least(pessoa_id - pessoa_id % 6 + 4, CASE tipo WHEN 'PF' THEN maior_pf ELSE maior_pj END) ELSE pessoa_id END"
_MOST = "(SELECT max(pessoa_id) FILTER (WHERE tipo = 'PF') AS maior_pf, max(pessoa_id) FILTER (WHERE tipo = 'PJ') AS maior_pj FROM pessoa) x"
query("people_merge", "pessoa movimentacao", f"""
, q AS ({PEOPLE.format(p="pessoa")}), e AS (SELECT q.*, {_END} AS fica FROM q, {_MOST}),
a AS (SELECT g.tipo, g.fica, list(DISTINCT g.n) AS ns FROM (SELECT tipo, fica, nome AS n FROM e WHERE fica <> pessoa_id UNION ALL SELECT tipo, fica, '{ALIAS}' FROM e WHERE fica <> pessoa_id AND com_alias) g GROUP BY 1, 2)
SELECT e.tipo, pessoa_id, deletado OR e.fica <> pessoa_id AS deletado, CASE WHEN ns IS NOT NULL THEN list_aggregate(list_sort(list_distinct(list_concat(ns, CASE WHEN com_alias THEN ['{ALIAS}'] ELSE [] END))), 'string_agg', ',') WHEN com_alias THEN '{ALIAS}' END AS aliases FROM e LEFT JOIN a ON a.tipo = e.tipo AND a.fica = e.pessoa_id""")(
    lambda p, m: _merged(p, m)[0].select("tipo", "pessoa_id", "deletado", F.array_join("aliases", ",").alias("aliases"))
)
query("people_merge_references", "pessoa movimentacao", f"""
SELECT id, tipo, CASE WHEN real THEN {_END} ELSE pessoa_id END AS pessoa FROM (SELECT m.id, CASE WHEN m.pessoa_id IS NOT NULL THEN CASE WHEN m.id % 3 = 0 THEN 'PJ' ELSE 'PF' END END AS tipo, m.pessoa_id, EXISTS (SELECT 1 FROM pessoa q WHERE q.pessoa_id = m.pessoa_id AND q.tipo = CASE WHEN m.id % 3 = 0 THEN 'PJ' ELSE 'PF' END) AS real FROM movimentacao m), {_MOST}""")(
    lambda p, m: _merged(p, m)[1]["linhas"].select("id", "pessoa.tipo", F.col("pessoa.id").alias("pessoa"))
)
CONFLICTS = "SELECT pessoa_id * 10 + k AS conflito_id, tipo, CASE WHEN pessoa_id % 8 <> 0 THEN pessoa_id END AS pessoa_id, 'Nome ' || CAST(k AS VARCHAR(2)) AS nome_proposto, CASE WHEN pessoa_id % 5 = 0 THEN 'RESOLVIDO' ELSE 'PENDENTE' END AS status, CAST(NULL AS VARCHAR(20)) AS resolucao, CASE WHEN pessoa_id % 3 = 0 THEN '—' ELSE 'SP' END AS uf, CASE WHEN pessoa_id % 4 = 0 THEN 0 ELSE 2024 END AS exercicio FROM {p}, (SELECT 1 AS k UNION ALL SELECT 2) k WHERE tipo = 'PF'"


def _resolved(p: DataFrame) -> dict[str, DataFrame]:
    conflicts = p.sparkSession.sql(CONFLICTS, p=p)
    k = F.col("conflito_id")
    kind = F.when(k % 6 < 3, "ATUALIZAR_NOME").when(k % 6 < 5, "MANTER_NOME").otherwise("IGNORADO")
    first = conflicts.where("conflito_id % 7 <> 0").select("conflito_id", (k * 7919 % 1000003).alias("ordem"), kind.alias("resolucao"))
    again = first.where("conflito_id % 4 = 0").select("conflito_id", F.col("ordem") + 2000000, F.lit("IGNORADO"))
    lost = first.where("conflito_id % 11 = 0").select(-k, F.col("ordem") + 4000000, F.lit("IGNORADO"))
    return people.resolve_conflicts(conflicts, _people(p), first.union(again).union(lost))


query("conflict_resolution", "pessoa", f"""
, c AS ({CONFLICTS.format(p="pessoa")}), n AS (SELECT *, CASE WHEN status = 'PENDENTE' AND conflito_id % 7 <> 0 THEN CASE WHEN conflito_id % 6 < 3 THEN 'ATUALIZAR_NOME' WHEN conflito_id % 6 < 5 THEN 'MANTER_NOME' ELSE 'IGNORADO' END END AS nova, conflito_id * 7919 % 1000003 AS ordem FROM c),
nm AS (SELECT tipo, pessoa_id, arg_max(nome_proposto, ordem) AS novo FROM n WHERE nova = 'ATUALIZAR_NOME' AND pessoa_id IS NOT NULL GROUP BY 1, 2)
SELECT conflito_id, CASE WHEN nova IS NULL THEN status WHEN nova = 'IGNORADO' THEN 'IGNORADO' ELSE 'RESOLVIDO' END AS status, CASE WHEN nova <> 'IGNORADO' THEN nova END AS resolucao, coalesce(novo, q.nome) AS nome FROM n LEFT JOIN nm USING (tipo, pessoa_id) LEFT JOIN pessoa q ON q.tipo = n.tipo AND q.pessoa_id = n.pessoa_id""")(
    lambda p: (d := _resolved(p))["conflitos"].join(d["pessoas"].select("tipo", "pessoa_id", "nome"), ["tipo", "pessoa_id"], "left").select("conflito_id", "status", "resolucao", "nome")
)


def _drafts(m: DataFrame, keep: str) -> DataFrame:
    """Drafts of two lines each, for the lines that keep names."""
    d = m.where(keep)
    line = lambda at, i, file, role: F.struct(F.lit(at).alias("posicao"), i.cast("long").alias("id"), file.cast("long").alias("arquivo_id"), F.lit(role).alias("papel"))
    lines = F.array(line(0, F.col("id"), F.col("arquivo_id"), "PIX"), line(1, F.col("id") + 1, F.lit(None), "COMPLETO"))
    guess = F.array(F.struct(F.lit("VALOR").alias("tipo"), F.col("confianca").alias("confianca"), F.lit("x").alias("detalhe")))
    return d.select("data_movimento", "valor", "direcao", "confianca", F.lit(None).cast("struct<tipo:string,id:bigint>").alias("pessoa"), F.lit("teste").alias("justificativa"), lines.alias("linhas"), guess.alias("hipoteses"), F.col("sessao_id").cast("long").alias("sessao_id"))


def replaced(m: DataFrame, path: str) -> None:
    """Two runs over a store: all sessions at first, then those of even number with other drafts, one approved before."""
    lines = m.select("id", F.when(F.col("id") % 4 == 1, "Pessoa").otherwise(" ").alias("remetente_destinatario"))
    sessions = m.select("sessao_id").distinct()
    events.replace_pending(path, _drafts(m, "id % 3 = 0"), lines, sessions)
    store = events.written(events.stored(m.sparkSession, path), "store")
    approved = store.withColumn("status", F.when(F.element_at("linhas", 1)["id"] % 2 == 0, "APROVADO").otherwise(F.col("status")))
    approved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sessao_id").parquet(path)
    events.replace_pending(path, _drafts(m, "id % 5 = 0 AND sessao_id % 2 = 0"), lines, sessions.where("sessao_id % 2 = 0"))


def _store(m: DataFrame) -> DataFrame:
    path = fresh_path(m.sparkSession, "events")
    replaced(m, path)
    return events.stored(m.sparkSession, path).select("sessao_id", F.element_at("linhas", 1)["id"].alias("primeira"), "status", "valor", "remetente_destinatario", F.size("linhas").alias("n_linhas"), F.element_at("hipoteses", 1)["confianca"].alias("hipotese"))


query("replaced_events", "movimentacao", """
SELECT CAST(sessao_id AS BIGINT) AS sessao_id, CAST(id AS BIGINT) AS primeira, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'APROVADO' ELSE 'PENDENTE' END AS status, valor, CASE WHEN id % 4 = 1 OR (id % 4 = 0 AND EXISTS (SELECT 1 FROM movimentacao o WHERE o.id = m.id + 1)) THEN 'Pessoa' END AS remetente_destinatario, 2 AS n_linhas, confianca AS hipotese
FROM movimentacao m WHERE CASE WHEN sessao_id % 2 = 0 THEN (id % 3 = 0 AND id % 2 = 0) OR id % 5 = 0 ELSE id % 3 = 0 END""")(_store)
