"""Deterministic match of lines with the registry, rematch of pending lines, and approval of consolidation events.

Decisions are taken one after another, and each approval rematches all pending lines of its state and year. None of that
is run one by one here: what a match makes of a line depends on the registry and the line's own document and counterparty
alone, so rematching twice is rematching once, and a line's last state follows from its first and last touches and from
the first approval of its state and year. Only descriptions feed on each other; they are merged in rounds, as many as the
longest chain of events of which each takes the main line of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.cells import name_is_empty
from ledgerloom.functions.documents import BLANK
from ledgerloom.operators.consolidate import linked
from ledgerloom.operators.ledger import CONFLICT_CAP, HIGH, missing_fields
from ledgerloom.operators.registry import link
from ledgerloom.operators.storage import written

PENDING = ("RASCUNHO", "PENDENTE_REVISAO")
# The names of people that stand for unknown ones.
STUBS = {"PF": "DESCONHECIDO", "PJ": "DESCONHECIDA"}
CROSSED, CROSSED_TEXT = "CRUZAMENTO_PDF", "Consolidação aprovada"
NOT_FOUND, PROCESSED = "Evento de consolidação não encontrado", "Evento já processado"
EVIDENCE = "array<struct<tipo:string,peso:double>>"


def status_by_tier(tier: Column, score: Column, person: Column, blocked: Column, high: float = HIGH) -> Column:
    """CONFIRMADO for the highest tier with a person, a high score and nothing that blocks it; else PENDENTE_REVISAO."""
    return F.when((tier == "ALTA") & (score >= high) & person & ~blocked, "CONFIRMADO").otherwise("PENDENTE_REVISAO")


def matches(sought: DataFrame, registry: DataFrame, classes: DataFrame | None = None, high: float = HIGH) -> DataFrame:
    """What the registry makes of each row of sought (key, id, cpf, cnpj, remetente_destinatario).

    key, tier, pessoa (tipo and id, or null), evidencias (new, in order), confianca, bloqueio_export and status. Confidence
    is the sum of the evidence's weights, at most 1, and at most CONFLICT_CAP with a conflict. A line is blocked unless
    classes (movimentacao_id and the required fields) hold all fields for its id; without classes every line is.
    """
    lines = sought.select(F.col("key").alias("id"), "cpf", "cnpj", F.when(~name_is_empty(F.col("remetente_destinatario")), F.col("remetente_destinatario")).alias("nome"), F.lit(None).cast("string").alias("hora"), F.lit(None).cast("string").alias("nr_documento"))
    found = link(linked(lines, registry)).withColumnRenamed("id", "key")
    kinds = F.filter(F.split("evidencias", ","), lambda t: t != "")
    weighed = F.transform(kinds, lambda t, i: F.struct(t.alias("tipo"), F.when(i == 0, F.col("peso")).otherwise(0.0).alias("peso")))
    conflict = F.exists(kinds, lambda t: t.startswith("CONFLITO"))
    score = F.least(F.lit(1.0), F.col("peso"), F.when(conflict, CONFLICT_CAP))
    d = found.select("key", "tier", "pessoa", weighed.alias("evidencias"), score.alias("confianca"))
    if classes is None:
        d = d.withColumn("bloqueio_export", F.lit(True))
    else:
        whole = classes.select(F.col("movimentacao_id").alias("id"), (F.size(missing_fields()) > 0).alias("_gaps"))
        d = d.join(sought.select("key", "id").join(whole, "id", "left").select("key", F.coalesce("_gaps", F.lit(True)).alias("bloqueio_export")), "key")
    return d.withColumn("status", status_by_tier(F.col("tier"), F.col("confianca"), F.col("pessoa").isNotNull(), F.col("bloqueio_export"), high))


def rematchable(status: Column, named: Column, person: Column, stub: Column) -> Column:
    """Whether a rematch takes a line: it is pending, has a document or a name, and no person but a stub."""
    return status.isin(*PENDING) & named & (person.isNull() | stub)


def has_lead(cpf: str = "cpf", cnpj: str = "cnpj", name: str = "remetente_destinatario") -> Column:
    return F.col(cpf).isNotNull() | F.col(cnpj).isNotNull() | ~name_is_empty(F.col(name))


def stubs(registry: DataFrame) -> DataFrame:
    """pessoa (tipo and id) of the registry's people that stand for unknown ones; _stub is true."""
    name = F.upper(F.regexp_replace(F.col("nome"), rf"^{BLANK}|{BLANK}$", ""))
    who = F.struct("tipo", F.col("pessoa_id").alias("id"))
    is_stub = F.coalesce(*[F.when(F.col("tipo") == k, name == v) for k, v in STUBS.items()], F.lit(False))
    return registry.where(is_stub).select(who.alias("pessoa"), F.lit(True).alias("_stub")).distinct()


def _with_stub(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """lines with _stub: whether their pessoa is a stub. Lines without a person don't travel to the join's keys."""
    known = lines.where("pessoa IS NOT NULL").join(stubs(registry), "pessoa", "left").withColumn("_stub", F.coalesce("_stub", F.lit(False)))
    return known.unionByName(lines.where("pessoa IS NULL").withColumn("_stub", F.lit(False))).select(*lines.columns, "_stub")


NEW = ("pessoa", "confianca", "bloqueio_export", "status")


def deterministic_match(lines: DataFrame, evidence: DataFrame, registry: DataFrame, ids: DataFrame | None = None, classes: DataFrame | None = None, high: float = HIGH) -> tuple[DataFrame, DataFrame]:
    """lines and evidence after a match of the lines named in ids (id; all of them without it).

    lines: id, cpf, cnpj, remetente_destinatario, pessoa (tipo and id), confianca, bloqueio_export, status and more;
    evidence: movimentacao_id, tipo, peso. A matched line's evidence is replaced as a whole, its person too (by none, if
    the registry has none), and score, block and status are worked out from the new evidence in the same pass. Repeated
    and unknown ids do nothing more; empty tables stay empty.
    """
    some = lines if ids is None else lines.join(ids.select("id").distinct(), "id", "left_semi")
    found = written(matches(some.withColumn("key", F.col("id")), registry, classes, high), "matches")
    new = found.select(F.col("key").alias("id"), *[F.col(c).alias(f"_{c}") for c in NEW], F.lit(True).alias("_found"))
    d = lines.join(new, "id", "left")
    out = d.select(*[F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in NEW else F.col(c) for c in lines.columns])
    kept = evidence.select("movimentacao_id", "tipo", "peso").join(found.select(F.col("key").alias("movimentacao_id")), "movimentacao_id", "left_anti")
    return out, kept.unionByName(_evidence_rows(found.select(F.col("key").alias("movimentacao_id"), "evidencias")))


def _evidence_rows(d: DataFrame) -> DataFrame:
    return d.select("movimentacao_id", F.explode("evidencias").alias("e")).select("movimentacao_id", "e.tipo", "e.peso")


def rematch_pending(lines: DataFrame, evidence: DataFrame, registry: DataFrame, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """deterministic_match() of the lines that rematchable() takes, within the (uf, exercicio) of scope or everywhere."""
    d = _with_stub(lines, registry).where(rematchable(F.col("status"), has_lead(), F.col("pessoa"), F.col("_stub")))
    if scope is not None:
        d = d.join(scope.select("uf", "exercicio").distinct(), ["uf", "exercicio"], "left_semi")
    return deterministic_match(lines, evidence, registry, d.select("id"))


def decided(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """evento_id, ordem, decisao and resultado of each decision: aprovado, rejeitado, or the error that it meets.

    An approval wants a pending event, so it counts only as the first decision on it; a rejection is always taken.
    """
    first = F.min("ordem").over(Window.partitionBy("evento_id"))
    d = decisions.withColumn("_first", first).join(events.select("evento_id", "status"), "evento_id", "left")
    good = (F.col("status") == "PENDENTE") & (F.col("ordem") == F.col("_first"))
    result = F.when(F.col("decisao") == "REJEITAR", F.when(F.col("status").isNotNull(), "rejeitado").otherwise(NOT_FOUND)).when(F.col("status").isNull(), NOT_FOUND).when(good, "aprovado").otherwise(PROCESSED)
    return d.select("evento_id", "ordem", "decisao", result.alias("resultado"))


def merged_descriptions(touches: DataFrame, lines: DataFrame) -> DataFrame:
    """evento_id, canonica_id, ordem and descricao: the distinct descriptions of every event's lines, joined in order.

    touches: evento_id, ordem, posicao, id, canonica_id. A line's description is that of the last event before which
    made it a main line, else its own. Events without such a line are done in one pass; chains take a round each.
    """
    last_main = F.expr("last(CASE WHEN id = canonica_id THEN evento_id END, true) OVER (PARTITION BY id ORDER BY ordem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    own = lines.select("id", F.col("descricao_raw").alias("texto"))
    parts = written(touches.withColumn("_antes", last_main).join(own, "id", "left"), "parts")
    joined = lambda d: d.groupBy("evento_id", "canonica_id", "ordem").agg(F.array_sort(F.collect_list(F.struct("posicao", "id", F.trim(F.coalesce("texto", F.lit(""))).alias("texto")))).alias("t")).select("evento_id", "canonica_id", "ordem", F.array_join(F.array_distinct(F.filter(F.transform("t", lambda x: x["texto"]), lambda x: x != "")), " | ").alias("descricao"))
    waiting = parts.where("_antes IS NOT NULL").select("evento_id").distinct()
    done = joined(parts.join(waiting, "evento_id", "left_anti"))
    rest = written(parts.join(waiting, "evento_id", "left_semi"), "chained")
    if rest.isEmpty():
        return done
    done = written(done, "merged")
    while not rest.isEmpty():
        known = done.select(F.col("evento_id").alias("_antes"), F.col("descricao").alias("_nova"))
        rest = written(rest.join(known, "_antes", "left").withColumns({"texto": F.coalesce("_nova", "texto"), "_antes": F.when(F.col("_nova").isNull(), F.col("_antes"))}).drop("_nova"), "chained")
        waiting = rest.where("_antes IS NOT NULL").select("evento_id").distinct()
        now = written(joined(rest.join(waiting, "evento_id", "left_anti")), "merged")
        if now.isEmpty():
            raise ValueError("events wait for each other: decisions must have an order")
        done, rest = done.unionByName(now), written(rest.join(waiting, "evento_id", "left_semi"), "chained")
    return done


def approve(lines: DataFrame, evidence: DataFrame, events: DataFrame, event_lines: DataFrame, registry: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Takes decisions (evento_id, ordem, decisao: APROVAR or REJEITAR) in their order: linhas, evidencias, eventos, decisoes.

    lines: id, uf, exercicio, status, pessoa, remetente_destinatario, descricao_raw, confianca, bloqueio_export,
    canonica_id, cpf, cnpj. events: evento_id, uf, exercicio, status, remetente_destinatario, confianca, canonica_id.
    event_lines: evento_id, posicao, id, papel. ordem is unique; a session's lines share its state and year.

    An approval gives the event's main line the merged description, counterparty and confidence, ties its other lines to
    it as REJEITADO, matches the main line with the registry (which may take the event's person away), adds the crossing
    as evidence, and rematches what is pending in the state and year, the main line too: its crossing stays only if the
    match gave it a person that is no stub, or if it has neither document nor name.
    """
    outcome = written(decided(events, decisions), "decided")
    good = outcome.where("resultado = 'aprovado'").select("evento_id", "ordem")
    rank = F.when(F.col("papel") == "COMPLETO", 0).when(F.col("papel") == "PIX", 1).otherwise(2)
    main = event_lines.groupBy("evento_id").agg(F.min_by("id", F.struct(rank, "posicao", "id")).alias("canonica_id"))
    approved = written(good.join(events.select("evento_id", "uf", "exercicio", "remetente_destinatario", "confianca"), "evento_id").join(main, "evento_id"), "approved")
    touches = written(event_lines.select("evento_id", "posicao", "id").join(approved.select("evento_id", "ordem", "canonica_id"), "evento_id"), "touches")

    # What each line was touched by: its first and last touch, and the last event that made it a main line or absorbed it.
    is_main = F.col("id") == F.col("canonica_id")
    by_line = touches.groupBy("id").agg(
        F.min("ordem").alias("_first"), F.max("ordem").alias("_last"), F.max(F.when(is_main, F.struct("ordem", "evento_id"))).alias("_main"), F.max(F.when(~is_main, F.struct("ordem", "canonica_id"))).alias("_absorbed"),
    )
    scopes = approved.groupBy("uf", "exercicio").agg(F.min("ordem").alias("_opened"))
    state = _with_stub(lines, registry).join(by_line, "id", "left").join(scopes, ["uf", "exercicio"], "left")
    early = rematchable(F.col("status"), has_lead(), F.col("pessoa"), F.col("_stub")) & F.coalesce(F.col("_opened") < F.coalesce("_first", F.col("_opened") + 1), F.lit(False))
    state = written(state.withColumn("_early", early), "state")

    # The registry is asked once: for rematched lines as they were, and for main lines under their last event's name.
    last = state.where("_main IS NOT NULL").select(F.col("id"), F.col("_main.evento_id").alias("evento_id"), "cpf", "cnpj")
    under = last.join(approved.select("evento_id", F.col("remetente_destinatario").alias("_nome"), F.col("confianca").alias("_peso")), "evento_id")
    key = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("id").alias("id")).alias("key")
    sought = state.where("_early AND _main IS NULL").select(key("own"), "id", "cpf", "cnpj", "remetente_destinatario").unionByName(under.select(key("event"), "id", "cpf", "cnpj", F.col("_nome").alias("remetente_destinatario")))
    found = matches(sought, registry).select(F.col("key.kind").alias("_kind"), F.col("key.id").alias("id"), *[F.col(c).alias(f"_{c}") for c in (*NEW, "evidencias")])
    stub_of = _with_stub(found.withColumnRenamed("_pessoa", "pessoa"), registry).withColumnsRenamed({"pessoa": "_pessoa", "_stub": "_new_stub"})
    texts = merged_descriptions(touches, lines).groupBy("canonica_id").agg(F.max_by("descricao", "ordem").alias("_texto")).withColumnRenamed("canonica_id", "id")
    d = state.join(stub_of, "id", "left").join(under.select("id", "_nome", "_peso"), "id", "left").join(texts, "id", "left")

    new, as_main, absorbed_last = F.col("_kind").isNotNull(), F.col("_main").isNotNull(), F.coalesce(F.col("_absorbed.ordem") == F.col("_last"), F.lit(False))
    after = F.when(new, F.col("_status")).otherwise(F.col("status"))
    changed = {
        "status": F.when(absorbed_last, "REJEITADO").otherwise(after), "canonica_id": F.coalesce("_absorbed.canonica_id", "canonica_id"),
        "remetente_destinatario": F.when(as_main, F.col("_nome")).otherwise(F.col("remetente_destinatario")), "descricao_raw": F.when(as_main, F.col("_texto")).otherwise(F.col("descricao_raw")),
        **{c: F.when(new, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("pessoa", "confianca", "bloqueio_export")},
    }
    lead = F.col("cpf").isNotNull() | F.col("cnpj").isNotNull() | ~name_is_empty(F.col("_nome"))
    again = rematchable(F.col("_status"), lead, F.col("_pessoa"), F.col("_new_stub"))
    crossing = F.when(as_main & ~again, F.array(F.struct(F.lit(CROSSED).alias("tipo"), F.col("_peso").alias("peso")))).otherwise(F.array().cast(EVIDENCE))
    d = written(d.withColumn("_prova", F.concat("_evidencias", crossing)), "approved_lines")
    kept = evidence.select("movimentacao_id", "tipo", "peso").join(d.where(new).select(F.col("id").alias("movimentacao_id")), "movimentacao_id", "left_anti")
    proofs = kept.unionByName(_evidence_rows(d.where(new).select(F.col("id").alias("movimentacao_id"), F.col("_prova").alias("evidencias"))))
    final = outcome.groupBy("evento_id").agg(F.count_if(F.col("resultado") == "rejeitado").alias("_nao"), F.count_if(F.col("resultado") == "aprovado").alias("_sim"))
    known = events.join(final, "evento_id", "left").join(approved.select("evento_id", F.col("canonica_id").alias("_canonica")), "evento_id", "left")
    status = F.when(F.col("_nao") > 0, "REJEITADO").when(F.col("_sim") > 0, "APROVADO").otherwise(F.col("status"))
    result = {"status": status, "canonica_id": F.coalesce("_canonica", "canonica_id")}
    return {
        "linhas": d.select(*[changed.get(c, F.col(c)).alias(c) for c in lines.columns]), "evidencias": proofs,
        "eventos": known.select(*[result.get(c, F.col(c)).alias(c) for c in events.columns]), "decisoes": outcome,
    }
