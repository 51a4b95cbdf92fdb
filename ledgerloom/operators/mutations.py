"""Changes of the ledger as new tables: deletions, purges, edit logs, upserts and import counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ledger import HIGH

# States in which a line may be deleted.
DELETABLE = ("RASCUNHO", "PENDENTE_REVISAO", "REJEITADO")
# The counter that each action of a registry import adds to.
COUNTERS = {"insere": "inseridos", "restaura": "atualizados", "renomeia": "atualizados", "igual": "ignorados", "conflito": "conflitos"}


def soft_delete(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """id and resultado for each distinct id asked for: excluida, or the code of why it stays."""
    d = ids.select("id").distinct().join(ledger.select("id", "status", "deletado"), "id", "left")
    why = F.when(F.col("deletado"), "MOVIMENTACAO_DELETED").when(F.col("status") == "EXPORTADO", "MOVIMENTACAO_EXPORTADA").when(F.col("status") == "CONFIRMADO", "MOVIMENTACAO_CONFIRMADA")
    return d.select("id", F.coalesce(why, F.when(F.col("status").isin(*DELETABLE), "excluida"), F.lit("MOVIMENTACAO_NOT_FOUND")).alias("resultado"))


def purged(tables: dict[str, DataFrame], keys: dict[str, str], ledger: str, sessions: DataFrame) -> dict[str, DataFrame]:
    """All tables without what belongs to the sessions: the ledger's lines by sessao_id, others by the column that names their line."""
    lines = tables[ledger].join(sessions.select("sessao_id").distinct(), "sessao_id", "left_semi").select(F.col("id").alias("_gone"))
    return {name: t.join(lines, F.col(keys[name]) == F.col("_gone"), "left_anti") for name, t in tables.items()}


def edited(rows: DataFrame, log: DataFrame, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """rows after an append-only log of edits (key, campo, valor, ordem): of each field the last edit counts, a null clears it."""
    last = [F.max_by(F.struct(F.col("valor").alias("v")), F.when(F.col("campo") == c, F.col("ordem"))).alias(f"_{c}") for c in columns]
    d = rows.join(log.where(F.col("campo").isin(*columns)).groupBy(key).agg(*last), key, "left")
    kinds = dict(rows.dtypes)
    return d.withColumns({c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v").cast(kinds[c])).otherwise(F.col(c)) for c in columns}).select(rows.columns)


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Both tables merged by key; of several rows of a key the last of the new ones counts, else the old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def import_counters(actions: DataFrame) -> DataFrame:
    """contador and n of classified upserts; a counter without rows is 0."""
    named = F.create_map(*[F.lit(x) for kv in COUNTERS.items() for x in kv])
    counts = actions.select(named[F.col("acao")].alias("contador")).groupBy("contador").agg(F.count("*").alias("n"))
    every = actions.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(COUNTERS.values())], "contador string")
    return every.join(counts, "contador", "left").select("contador", F.coalesce("n", F.lit(0)).alias("n"))


def batch_approvable(events: DataFrame, least: float = HIGH) -> DataFrame:
    """Pending events with a person and enough confidence."""
    return events.where((F.col("status") == "PENDENTE_REVISAO") & (F.col("confianca") >= least) & F.col("pessoa_id").isNotNull())
