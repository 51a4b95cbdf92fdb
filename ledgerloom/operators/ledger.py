"""Reads of the ledger: scopes, approved lists, counts, guards and pending items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.documents import mask_document
from ledgerloom.functions.fields import month_bounds

APPROVED = ("CONFIRMADO", "EXPORTADO")
LOW, HIGH = 0.6, 0.85
PER_PAGE, MOST_PER_PAGE, MOST_EXPORTED = 50, 100, 50_000
REQUIRED = ("fonte_recurso", "natureza_recurso", "tipo_origem_recurso")
# The weight of evidence that names none, and the cap that a conflict sets.
WEIGHTS = {"CPF_EXATO": 0.45, "VALOR_DATA": 0.25, "NOME_ALTO": 0.2, "NOME_FUZZY": 0.1, "IA": 0.15}
CONFLICT_CAP = 0.4
# States that a line may go to.
TRANSITIONS = {
    "RASCUNHO": ("PENDENTE_REVISAO", "REJEITADO"),
    "PENDENTE_REVISAO": ("CONFIRMADO", "REJEITADO", "RASCUNHO"),
    "CONFIRMADO": ("PENDENTE_REVISAO", "EXPORTADO"),
    "EXPORTADO": (),
    "REJEITADO": ("RASCUNHO",),
}


def approved(ledger: DataFrame, uf=None, exercicio: int | None = None, month: str | None = None) -> DataFrame:
    """Confirmed or exported lines that are neither deleted nor absorbed by another, within the scope given."""
    kept = ledger.where(F.col("status").isin(*APPROVED) & ~F.col("deletado") & F.col("canonica_id").isNull())
    if uf is not None:
        kept = kept.where(F.col("uf") == uf)
    if exercicio is not None:
        kept = kept.where(F.col("exercicio") == exercicio)
    if month is not None:
        first, last = month_bounds(month)
        kept = kept.where(F.col("data_movimento").between(F.expr(first), F.expr(last)))
    return kept


def prestador_name() -> Column:
    """The state-level name of a filing entity, else the municipal one."""
    return F.coalesce("nome_estadual", "nome_municipal")


def described(lines: DataFrame, people: DataFrame, prestadores: DataFrame) -> DataFrame:
    """Lines with the names of their filing entity and person and the masked document.

    Neither side is forced to be broadcast: the filing entities are few, but people grow with the ledger.
    """
    names = prestadores.select("cnpj_prestador", prestador_name().alias("prestador_nome"))
    person = people.where("tipo = 'PF'").select("pessoa_id", mask_document(F.col("documento")).alias("documento"), F.col("nome").alias("pessoa_nome"))
    return lines.join(names, "cnpj_prestador", "left").join(person, "pessoa_id", "left")


LISTED = ("id", "data_movimento", "valor", "direcao", "status", "cnpj_prestador", "prestador_nome", "documento", "pessoa_nome", "confianca")


def approved_list(ledger: DataFrame, people: DataFrame, prestadores: DataFrame, page: int = 1, per_page: int = PER_PAGE, **scope) -> DataFrame:
    """One page of the approved lines, newest first, then by filing entity and id. Names are joined to the page's rows only."""
    per_page = min(MOST_PER_PAGE, max(1, per_page))
    rows = approved(ledger, **scope).orderBy(F.col("data_movimento").desc(), "cnpj_prestador", "id").offset((max(1, page) - 1) * per_page).limit(per_page)
    return described(rows, people, prestadores).select(*LISTED)


def approved_export(ledger: DataFrame, people: DataFrame, prestadores: DataFrame, **scope) -> DataFrame:
    """All approved lines of a scope; more than MOST_EXPORTED are an error."""
    rows = approved(ledger, **scope)
    if rows.limit(MOST_EXPORTED + 1).count() > MOST_EXPORTED:
        raise ValueError(f"more than {MOST_EXPORTED} lines: narrow the scope")
    return described(rows, people, prestadores).select(*LISTED)


def approved_summary(ledger: DataFrame, *by: str, **scope) -> DataFrame:
    """Counts of the approved lines by state."""
    return approved(ledger, **scope).groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in APPROVED])


def approved_prestadores(ledger: DataFrame, prestadores: DataFrame) -> DataFrame:
    """The filing entities with approved lines, and their names."""
    found = approved(ledger).select("cnpj_prestador").distinct()
    return found.join(prestadores.select("cnpj_prestador", prestador_name().alias("prestador_nome")), "cnpj_prestador", "left")


def status_counts(ledger: DataFrame, scoped: bool = False) -> DataFrame:
    """Lines by state; scoped: also by state, uf and year, in the same pass."""
    if not scoped:
        return ledger.groupBy("status").agg(F.count("*").alias("n"))
    return ledger.groupingSets([["status"], ["status", "uf", "exercicio"]], "status", "uf", "exercicio").agg(F.count("*").alias("n"), F.grouping("uf").cast("int").alias("is_global"))


def confidence_buckets(ledger: DataFrame) -> DataFrame:
    c = F.col("confianca")
    return ledger.where("NOT deletado").agg(F.count_if(c < LOW).alias("baixa"), F.count_if((c >= LOW) & (c < HIGH)).alias("media"), F.count_if(c >= HIGH).alias("alta"))


def blocking() -> Column:
    return ~F.col("status").isin(*APPROVED) | F.col("bloqueio_export")


def export_guard(ledger: DataFrame) -> DataFrame:
    """For each filing entity and year: the blocking lines, and whether it can be exported. Deleted and absorbed lines block too."""
    return ledger.groupBy("cnpj_prestador", "exercicio").agg(F.count_if(blocking()).alias("bloqueios")).withColumn("exportavel", F.col("bloqueios") == 0)


def period_by_session(ledger: DataFrame) -> DataFrame:
    return ledger.where("NOT deletado").groupBy("sessao_id").agg(F.min("data_movimento").alias("inicio"), F.max("data_movimento").alias("fim"), F.count("*").alias("n"))


def missing_fields() -> Column:
    """The required classification fields that are null or empty, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", f) for f in REQUIRED]))


def pending_report(ledger: DataFrame, classes: DataFrame) -> DataFrame:
    """The blocking lines with the reasons and the missing fields."""
    d = ledger.where(blocking()).join(classes, F.col("id") == F.col("movimentacao_id"), "left").withColumn("_gaps", missing_fields())
    blocked = F.col("bloqueio_export")
    reasons = F.array_compact(F.array(
        F.when(~F.col("status").isin(*APPROVED), F.concat(F.lit("status="), F.col("status"))),
        F.when(blocked & (F.size("_gaps") > 0), "campos_xsd_obrigatorios_faltantes").when(blocked, "bloqueio_export"),
        F.when(F.col("confianca") < LOW, "confianca_baixa"),
    ))
    motive = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("pendencia")
    return d.select("id", F.col("data_movimento").alias("data"), "valor", F.col("descricao_raw").alias("descricao"), motive.alias("motivo"), F.array_join("_gaps", ";").alias("campos_xsd_faltantes"), F.col("arquivo_id").alias("arquivo_origem"))


def evidence_scores(evidence: DataFrame) -> DataFrame:
    """For each line the sum of its evidence's weights, at most 1, and at most a conflict's cap."""
    default = F.coalesce(*[F.when(F.col("tipo") == k, F.lit(w)) for k, w in WEIGHTS.items()], F.lit(0.0))
    conflict = F.col("tipo").startswith("CONFLITO")
    weight = F.when(~conflict, F.coalesce("peso", default)).otherwise(0.0)
    cap = F.min(F.when(conflict, F.lit(CONFLICT_CAP)))
    return evidence.groupBy("movimentacao_id").agg(F.round(F.least(F.lit(1.0), F.sum(weight), cap), 6).alias("confianca"))


def confirm(ids: DataFrame, ledger: DataFrame, classes: DataFrame, evidence: DataFrame) -> DataFrame:
    """What becomes of each id asked for: confirmado with its new confidence, bloqueado or nao_encontrado."""
    live = ledger.where("NOT deletado").select("id", F.lit(True).alias("_found"))
    d = ids.join(live, "id", "left").join(classes.withColumnRenamed("movimentacao_id", "id"), "id", "left")
    d = d.join(evidence_scores(evidence).withColumnRenamed("movimentacao_id", "id"), "id", "left")
    outcome = F.when(F.col("_found").isNull(), "nao_encontrado").when(F.size(missing_fields()) > 0, "bloqueado").otherwise("confirmado")
    return d.select("id", outcome.alias("resultado"), F.when(outcome == "confirmado", F.coalesce("confianca", F.lit(0.0))).alias("confianca"))


def change_status(ledger: DataFrame, new: str) -> DataFrame:
    """Each line's state if it is asked to change to new, and why it may not."""
    allowed = F.col("status").isin(*[s for s, to in TRANSITIONS.items() if new in to])
    error = F.when(~allowed, "transicao").when((F.lit(new) == "CONFIRMADO") & F.col("bloqueio_export"), "bloqueio")
    return ledger.select("id", F.when(error.isNull(), new).otherwise(F.col("status")).alias("status_novo"), error.alias("erro"))


def system_stats(ledger: DataFrame) -> DataFrame:
    """All headline counts in one pass."""
    return ledger.agg(
        F.count("*").alias("total"), F.count_if("deletado").alias("deletadas"), F.count_if(F.col("canonica_id").isNotNull()).alias("absorvidas"),
        F.count_if(F.col("bloqueio_export") & ~F.col("deletado")).alias("bloqueadas"), F.count_if(F.col("pessoa_id").isNull()).alias("sem_pessoa"),
    )
