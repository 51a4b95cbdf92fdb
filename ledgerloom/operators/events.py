"""The store of consolidation events: a table whose rows hold an event with its lines and hypotheses, by session.

Parents and children are one row, so that one commit replaces both, and sessions are partitions, so that a run touches the
files of its own sessions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.storage import written

LINES = "array<struct<posicao:int,id:bigint,arquivo_id:bigint,papel:string>>"
HYPOTHESES = "array<struct<tipo:string,confianca:double,detalhe:string>>"
STORED = f"evento_id string, status string, data_movimento date, valor decimal(15,2), direcao string, confianca double, pessoa struct<tipo:string,id:bigint>, justificativa string, remetente_destinatario string, linhas {LINES}, hipoteses {HYPOTHESES}, sessao_id bigint"


def drafted(drafts: DataFrame, lines: DataFrame) -> DataFrame:
    """Pending events as the store holds them, from drafts (STORED without evento_id, status and remetente_destinatario).

    evento_id follows from the session and the lines, so that a rerun gives the same ones. The counterparty is that of
    the first of the event's lines (lines: id, remetente_destinatario) which has one.
    """
    names = lines.where("trim(coalesce(remetente_destinatario, '')) <> ''").select("id", F.col("remetente_destinatario").alias("_nome"))
    key = F.sha2(F.concat_ws("|", F.col("sessao_id").cast("string"), F.array_join(F.transform(F.array_sort(F.transform("linhas", lambda x: x["id"])), lambda i: i.cast("string")), ",")), 256)
    d = drafts.withColumn("evento_id", key)
    said = d.select("evento_id", F.explode("linhas").alias("x")).select("evento_id", "x.posicao", "x.id").join(names, "id").groupBy("evento_id").agg(F.min_by("_nome", F.struct("posicao", "id")).alias("remetente_destinatario"))
    d = d.drop("remetente_destinatario").join(said, "evento_id", "left").withColumn("status", F.lit("PENDENTE"))
    return d.select(*[F.col(c.split(" ", 1)[0]).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in _columns()])


def _columns() -> list[str]:
    out, depth, part = [], 0, ""
    for c in STORED:
        depth += c in "<("
        depth -= c in ">)"
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's events."""
    return spark.read.schema(STORED).parquet(path)


def replace_pending(path: str, drafts: DataFrame, lines: DataFrame, sessions: DataFrame) -> None:
    """Puts drafts in place of the pending events of the sessions (sessao_id) in the store under path.

    Events of these sessions that are approved or rejected stay; a draft that has the id of one of them is not stored
    again. A session without drafts loses its pending events. The new state is written aside first, then the sessions'
    partitions are overwritten in one commit; all other sessions' files stay as they are. Drafts of other sessions are
    an error. A rerun gives the same store.
    """
    spark = drafts.sparkSession
    asked = sessions.select("sessao_id").distinct()
    if not drafts.join(asked, "sessao_id", "left_anti").isEmpty():
        raise ValueError("a draft belongs to none of the sessions")
    new = drafted(drafts, lines).dropDuplicates(["evento_id"])
    try:
        old = read(spark, path).join(asked, "sessao_id", "left_semi").where("status <> 'PENDENTE'")
        old.schema  # noqa: B018 - a store that isn't there yet is found here
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = new.limit(0)
    kept = old.select(*new.columns)
    state = kept.unionByName(new.join(kept.select("evento_id"), "evento_id", "left_anti").select(*new.columns))
    # A session that is left with nothing keeps one row without an event, as only partitions with rows are overwritten.
    full = written(state, "events")
    bare = asked.join(full.select("sessao_id").distinct(), "sessao_id", "left_anti")
    for_bare = bare.select(*[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) if not c.startswith("sessao_id") else F.col("sessao_id").cast("bigint") for c in _columns()])
    full.unionByName(for_bare).hint("rebalance", "sessao_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sessao_id").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The store's events, without the rows that mark sessions with none."""
    return read(spark, path).where("evento_id IS NOT NULL")
