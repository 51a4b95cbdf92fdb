"""The person registry: search, counts and the classification of upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.documents import digits, names_agree, normalize_name


def search(people: DataFrame, ledger: DataFrame, term: str) -> DataFrame:
    """People whose name or document holds the term, with their live lines and the states they occur in."""
    number = "".join(c for c in term if c.isdigit())
    hit = F.col("nome").ilike(f"%{term}%")
    if number:
        hit = hit | digits(F.col("documento")).contains(number)
    uses = ledger.where("pessoa_id IS NOT NULL").groupBy("pessoa_id").agg(F.count("*").alias("n"), F.expr("listagg(DISTINCT cast(uf AS string), ', ') WITHIN GROUP (ORDER BY cast(uf AS string))").alias("ufs"))
    uses = uses.withColumn("tipo", F.lit("PF"))
    return people.where(hit).join(uses, ["tipo", "pessoa_id"], "left").select("tipo", "pessoa_id", "documento", "nome", F.coalesce("n", F.lit(0)).alias("movimentacoes"), "ufs")


def counts(ledger: DataFrame) -> DataFrame:
    """Lines of each person by state and year; deleted ones count."""
    return ledger.where("pessoa_id IS NOT NULL").groupBy("pessoa_id", "uf", "exercicio").agg(F.count("*").alias("n"))


# The weight of a document that the registry knows, and the share of it that a name alone has.
DOCUMENT_WEIGHT, NAME_SHARE = 0.45, 0.85


def link(lines: DataFrame) -> DataFrame:
    """How each line is tied to the registry: id, tier, comparacao, evidencias (comma-joined), peso, pessoa (tipo and id, or null).

    lines are those of consolidate.linked(): a document decides, CPF and CNPJ together are a conflict, and without a
    document a name counts if one person's alone agrees with it. Columns decide alone: nothing is joined here.
    """
    has = lambda f: F.coalesce(F.col(f), F.lit("")) != ""

    def compared(person: str) -> Column:
        short = (F.length(F.coalesce("nome", F.lit(""))) <= 3) | (F.length(f"{person}.nome") <= 3)
        return F.when(short, "indefinido").when(names_agree(F.col("nome"), F.col(f"{person}.nome")), "bate").otherwise("difere")

    def by_document(kind: str, person: str) -> Column:
        said = compared(person)
        found = F.struct(
            F.when(said == "bate", "ALTA").otherwise("MEDIA").alias("tier"), said.alias("comparacao"),
            F.when(said == "difere", f"{kind}_CADASTRO,NOME_DIVERGE_CADASTRO").otherwise(f"{kind}_CADASTRO").alias("evidencias"),
            F.lit(DOCUMENT_WEIGHT).alias("peso"), F.col(f"{person}.quem").alias("pessoa"),
        )
        return F.when(F.col(person).isNotNull(), found).otherwise(fixed("BAIXA", f"{kind}_SEM_CADASTRO"))

    def fixed(tier: str, evidence: str, compared: str = "indefinido", weight: float = 0.0, person: Column | None = None) -> Column:
        nobody = F.lit(None).cast("struct<tipo:string,id:bigint>")
        return F.struct(F.lit(tier).alias("tier"), F.lit(compared).alias("comparacao"), F.lit(evidence).alias("evidencias"), F.lit(weight).alias("peso"), (nobody if person is None else person).alias("pessoa"))

    verdict = (
        F.when(has("cpf") & has("cnpj"), fixed("REJEITADO", "CONFLITO_DOCUMENTO"))
        .when(has("cpf"), by_document("CPF", "pf"))
        .when(has("cnpj"), by_document("CNPJ", "pj"))
        .when(F.col("n_pessoas") == 1, fixed("MEDIA", "NOME_CADASTRO", "bate", DOCUMENT_WEIGHT * NAME_SHARE, F.col("unico")))
        .when(F.col("n_pessoas") > 1, fixed("REJEITADO", "CONFLITO_NOME"))
        .otherwise(fixed("BAIXA", ""))
    )
    return lines.select("id", verdict.alias("v")).select("id", "v.*")


def classify_upserts(known: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of each new row (documento, nome, ordem): insere, restaura, renomeia, igual or conflito.

    known has documento, nome and deletado. A stub (a name without letters) is renamed. Within a batch order counts: the
    first row of an unknown document inserts, and its later rows are compared with the name that it brought.
    """
    w = Window.partitionBy("documento").orderBy("ordem")
    rows = new.withColumn("_nome", normalize_name(F.col("nome"))).withColumn("_k", F.row_number().over(w)).withColumn("_first", F.first("_nome").over(w))
    d = rows.join(known.select("documento", normalize_name(F.col("nome")).alias("_was"), "deletado"), "documento", "left")
    stub = ~F.col("_was").rlike("[A-Z]")
    fresh = F.col("_was").isNull() | F.col("deletado") | stub
    first = F.when(F.col("_was").isNull(), "insere").when(F.col("deletado"), "restaura").when(stub, "renomeia")
    now = F.when(fresh, F.col("_first")).otherwise(F.col("_was"))
    action = F.when(fresh & (F.col("_k") == 1), first).when(F.col("_nome") == now, "igual").otherwise("conflito")
    return d.select("documento", "nome", "ordem", action.alias("acao"))
