"""The review sheet: rows, their state, order and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cells import clean_description
from ledgerloom.functions.documents import compare_names
from ledgerloom.operators.ledger import LOW


def row_state(doubtful: Column, confirmed: Column, person: Column, pending: Column, origins: Column, confidence: Column) -> Column:
    """extracao_duvidosa, merge_pendente, pronta or pendente."""
    blocked = doubtful & ~confirmed & ~person
    return F.when(blocked, "extracao_duvidosa").when(pending & (origins >= 2), "merge_pendente").when(person & (confidence >= LOW), "pronta").otherwise("pendente")


#: Confidence below which a line without an extraction's origin is doubtful.
DOUBTFUL = 0.4
# Evidence that says how a line is tied to the registry, that a page is to be looked at, and that a person confirmed a reading.
LINK_EVIDENCE = ("CPF_CADASTRO", "CNPJ_CADASTRO", "CPF_SEM_CADASTRO", "CNPJ_SEM_CADASTRO", "CONFLITO_DOCUMENTO", "CONFLITO_NOME", "NOME_DIVERGE_CADASTRO")
LOOK_AT_PAGE, CONFIRMED = "PAGINA_VERIFICAR", "EXTRACAO_CONFIRMADA"
ROW = ("fonte", "id", "sessao_id", "data_movimento", "valor", "direcao", "descricao", "descricao_raw", "justificativa", "nr_extrato_bancario", "confianca", "estado", "pessoa", "remetente_destinatario", "n_origens", "evento_status", "extracao_duvidosa", "extracao_confirmada", "nivel", "comparacao_nome", "evidencias", "campos", "hora", "indice_linha")


def merged_fields(parts: DataFrame, key: str, fields: str, *order: str) -> DataFrame:
    """key and campos: for every field of a key's maps its first value that says something, in the order given.

    The fields are grouped, not the maps, so that neither a key with very many parts nor a common field gathers in a row.
    """
    each = parts.select(key, F.struct(*order).alias("_at"), F.explode(fields).alias("_campo", "_valor")).where("_valor <> ''")
    first = each.groupBy(key, "_campo").agg(F.min_by("_valor", "_at").alias("_valor"))
    return first.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_campo", "_valor"))).alias("campos"))


def link_tier(evidence: Column, person: Column, compared: Column) -> Column:
    """REJEITADO, ALTA, MEDIA, BAIXA or null of a row by its kinds of evidence, whether it has a person, and how names compare."""
    some = lambda *kinds: F.arrays_overlap(evidence, F.array(*[F.lit(k) for k in kinds]))
    documented = F.when(some("CPF_CADASTRO", "CNPJ_CADASTRO") & (compared == "bate"), "ALTA").otherwise("MEDIA")
    return F.when(some("CONFLITO_DOCUMENTO", "CONFLITO_NOME"), "REJEITADO").when(person, documented).when(some("CPF_SEM_CADASTRO", "CNPJ_SEM_CADASTRO"), "BAIXA")


def live_lines(lines: DataFrame) -> DataFrame:
    return lines.where("NOT deletado AND canonica_id IS NULL")


def _kinds(evidence: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """id, evidencias (kinds, sorted), and whether the page or the reading was marked, of each line; kinds are few."""
    kept = F.col("tipo") if only is None else F.when(F.col("tipo").isin(*only), F.col("tipo"))
    return evidence.groupBy(F.col("movimentacao_id").alias("id")).agg(F.array_sort(F.collect_set(kept)).alias("evidencias"), F.bool_or(F.col("tipo") == LOOK_AT_PAGE).alias("_olhar"), F.bool_or(F.col("tipo") == CONFIRMED).alias("_confirmada"))


def _with_person(rows: DataFrame, people: DataFrame) -> DataFrame:
    """rows with the registry's name and document in pessoa; a person that the registry lacks is none."""
    known = people.select(F.struct("tipo", F.col("pessoa_id").alias("id")).alias("pessoa"), F.struct("tipo", F.col("pessoa_id").alias("id"), "nome", "documento").alias("_quem"))
    some = rows.where("pessoa IS NOT NULL").join(known, "pessoa", "left").drop("pessoa").withColumnRenamed("_quem", "pessoa")
    kind = "struct<tipo:string,id:bigint,nome:string,documento:string>"
    return some.unionByName(rows.where("pessoa IS NULL").withColumn("pessoa", F.lit(None).cast(kind)))


def _compared(name: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(name, F.lit("")))) < 3, "indefinido").otherwise(compare_names(name, F.col("pessoa.nome")))


def _finished(d: DataFrame) -> DataFrame:
    """The columns of ROW from rows with pessoa, _dito (the counterparty kept), _duvida, _pendente, _confirmada, evidencias, _nivel (whether a tier is told) and campos."""
    empty = F.create_map().cast("map<string,string>")
    d = d.withColumns({"evidencias": F.coalesce("evidencias", F.array().cast("array<string>")), "extracao_confirmada": F.coalesce("_confirmada", F.lit(False)), "campos": F.coalesce("campos", empty)})
    d = d.withColumns({"extracao_duvidosa": F.coalesce("_duvida", F.lit(False)) & ~F.col("extracao_confirmada"), "comparacao_nome": F.when(F.col("pessoa").isNotNull(), _compared(F.col("_dito")))})
    person = F.col("pessoa").isNotNull()
    told = F.when(F.col("_nivel"), link_tier(F.col("evidencias"), person, F.coalesce("comparacao_nome", F.lit("indefinido"))))
    field = lambda n: F.nullif(F.try_element_at("campos", F.lit(n)), F.lit(""))
    return d.withColumns({
        "nivel": told, "estado": row_state(F.col("extracao_duvidosa"), F.col("extracao_confirmada"), person, F.col("_pendente"), F.col("n_origens"), F.col("confianca")),
        "remetente_destinatario": F.coalesce(field("remetente_destinatario"), "_dito"), "descricao": clean_description(F.coalesce("descricao_raw", F.lit(""))), "hora": F.coalesce(field("hora"), "_hora"),
    }).select(*ROW)


def line_rows(lines: DataFrame, evidence: DataFrame, people: DataFrame) -> DataFrame:
    """Rows of a sheet made of single lines."""
    d = _with_person(lines, people).join(_kinds(evidence), "id", "left")
    doubtful = F.coalesce("_olhar", F.lit(False)) | (~F.col("tem_origem") & (F.col("confianca") < DOUBTFUL))
    d = d.withColumns({
        "fonte": F.lit("movimentacao"), "justificativa": F.lit(None).cast("string"), "n_origens": F.lit(1).cast("long"), "evento_status": F.lit(None).cast("string"), "_dito": F.col("remetente_destinatario"),
        "_duvida": doubtful, "_pendente": F.lit(False), "_nivel": F.lit(True), "_hora": F.nullif("hora", F.lit("")), "indice_linha": F.col("indice_linha").cast("long"),
    })
    return _finished(d)


def event_rows(events: DataFrame, event_lines: DataFrame, lines: DataFrame, evidence: DataFrame, people: DataFrame) -> DataFrame:
    """Rows of a sheet made of consolidation events and their lines.

    The COMPLETO line, else the first, gives the texts; fields are merged in the lines' order, an event is doubtful if a
    line without origin stands behind a low confidence, and evidence is that of all its lines, of the kinds in LINK_EVIDENCE.
    """
    members = event_lines.join(lines.select("id", "descricao_raw", F.coalesce(F.nullif(F.try_element_at("campos", F.lit("documento")), F.lit("")), "nr_extrato_bancario").alias("_documento"), "campos", "tem_origem", "indice_linha", F.nullif("hora", F.lit("")).alias("hora")), "id")
    members = members.join(_kinds(evidence, LINK_EVIDENCE), "id", "left")
    first = F.struct((F.col("papel") != "COMPLETO").alias("r"), "posicao", "id")
    by_event = members.groupBy("evento_id").agg(
        F.count("*").alias("n_origens"), F.min_by(F.struct("descricao_raw", F.col("_documento").alias("nr_extrato_bancario")), first).alias("p"), F.bool_or(~F.col("tem_origem")).alias("_sem_origem"),
        F.min_by("hora", F.when(F.col("hora").isNotNull(), F.struct("posicao", "id"))).alias("_hora"), F.bool_or("_confirmada").alias("_confirmada"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidencias")))).alias("evidencias"), F.min("indice_linha").cast("long").alias("indice_linha"),
    )
    d = _with_person(events, people).join(by_event, "evento_id", "left").join(merged_fields(members, "evento_id", "campos", "posicao", "id"), "evento_id", "left")
    d = d.withColumns({
        "fonte": F.lit("consolidacao"), "id": F.col("evento_id"), "descricao_raw": F.coalesce("p.descricao_raw", F.lit("")), "nr_extrato_bancario": F.col("p.nr_extrato_bancario"), "n_origens": F.coalesce("n_origens", F.lit(0)),
        "evento_status": F.col("status"), "_dito": F.col("remetente_destinatario"), "_duvida": F.col("_sem_origem") & (F.col("confianca") < DOUBTFUL), "_pendente": F.col("status") == "PENDENTE",
        "_nivel": F.size(F.coalesce("evidencias", F.array().cast("array<string>"))) > 0,
    })
    return _finished(d)


def sheet_parts(lines: DataFrame, events: DataFrame, event_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a sheet shows, as (events, lines): a session with events shows those that are not rejected, and of rejected
    ones the live lines that no shown event has; a session without events shows its live lines."""
    events = events.where("NOT deletado")
    shown = events.where("status <> 'REJEITADO'")
    with_events = events.select("sessao_id").distinct()
    in_shown = event_lines.join(shown.select("evento_id", F.col("sessao_id").alias("_s")), "evento_id").select("_s", "id").distinct()
    lost = event_lines.join(events.where("status = 'REJEITADO'").select("evento_id", F.col("sessao_id").alias("_s")), "evento_id").select("_s", "id").distinct().join(in_shown, ["_s", "id"], "left_anti")
    live = live_lines(lines)
    # A rejected event's line is shown in the event's session, whatever its own.
    lost_lines = live.join(lost, "id").withColumn("sessao_id", F.col("_s")).select(*lines.columns)
    return shown, live.join(with_events, "sessao_id", "left_anti").select(*lines.columns).unionByName(lost_lines)


def sheet(lines: DataFrame, evidence: DataFrame, events: DataFrame, event_lines: DataFrame, people: DataFrame) -> DataFrame:
    """The rows (ROW) of all sessions' sheets.

    lines: id, sessao_id, data_movimento, valor, direcao, descricao_raw, nr_extrato_bancario, confianca, pessoa (tipo and
    id), remetente_destinatario, tem_origem, indice_linha, hora (of the origin), campos (map), deletado, canonica_id. evidence: movimentacao_id
    and tipo. events: evento_id, sessao_id, status, deletado, data_movimento, valor, direcao, confianca, justificativa,
    pessoa, remetente_destinatario. event_lines: evento_id, posicao, id, papel. people: tipo, pessoa_id, nome, documento.
    """
    shown, single = sheet_parts(lines, events, event_lines)
    return event_rows(shown, event_lines, lines, evidence, people).unionByName(line_rows(single, evidence, people))


def origins(lines: DataFrame, events: DataFrame, event_lines: DataFrame) -> DataFrame:
    """fonte, id, sessao_id, movimentacao_id and arquivo_id: the lines that stand behind each row of the sheets."""
    shown, single = sheet_parts(lines, events, event_lines)
    of_events = shown.select("evento_id", "sessao_id").join(event_lines, "evento_id").join(lines.select("id", "arquivo_id"), "id").select(F.lit("consolidacao").alias("fonte"), F.col("evento_id").alias("id"), "sessao_id", F.col("id").alias("movimentacao_id"), "arquivo_id")
    return of_events.unionByName(single.select(F.lit("movimentacao").alias("fonte"), "id", "sessao_id", F.col("id").alias("movimentacao_id"), "arquivo_id"))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of a sheet; exportavel: all rows are ready and there is one."""
    state, person = F.col("estado"), F.col("pessoa").isNotNull()
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(state == "pronta").alias("prontas"), F.count_if(~person).alias("sem_pessoa"),
        F.count_if(F.length(F.coalesce("remetente_destinatario", F.lit(""))) < 3).alias("sem_remetente"), F.count_if(F.col("confianca") < LOW).alias("baixa_confianca"),
        F.count_if(state == "merge_pendente").alias("merge_pendente"), F.count_if(state == "extracao_duvidosa").alias("extracao_duvidosa"),
        F.count_if((F.col("nivel") == "BAIXA") & ~person).alias("doc_sem_cadastro"), F.count_if((F.col("comparacao_nome") == "difere") & person).alias("nome_diverge"),
    )
    return counts.withColumn("exportavel", (F.col("total") > 0) & (F.col("prontas") == F.col("total")))


def seconds_of(hour: Column) -> Column:
    """Seconds of a text of hours, minutes and seconds, the last two of which may lack; null if a part is no number."""
    parts = F.split(F.trim(hour), ":")
    numbers = F.transform(parts, lambda p: F.when(F.trim(p) == "", 0.0).otherwise(F.trim(p).try_cast("double")))
    part = lambda k: F.coalesce(F.get(numbers, F.lit(k)), F.lit(0.0))
    return F.when(~F.exists(numbers, lambda n: n.isNull()), part(0) * 3600 + part(1) * 60 + part(2))


# The orders a sheet may take: what stands before the chronological keys, and whether all keys run backwards.
ORDERS = {"cronologico_asc": ((), False), "cronologico_desc": ((), True), "confianca_desc": (("confianca",), True), "confianca_asc": (("confianca",), False), "valor_desc": (("valor",), True), "valor_asc": (("valor",), False)}


def ordering(order: str = "cronologico_asc") -> list[Column]:
    """Sort keys of a sheet by the order's name; a descending order turns every key round, those that break ties too.

    Chronologically rows go by date, then those with an hour before those without, by its seconds, then by the smallest
    line index (none last), document and id.
    """
    first, backwards = ORDERS.get(order, ORDERS["cronologico_asc"])
    hour = F.nullif("hora", F.lit(""))
    document = F.coalesce("nr_extrato_bancario", F.try_element_at("campos", F.lit("documento")), F.lit(""))
    keys = [*[F.col(c) for c in (*first, "data_movimento")], hour.isNull(), F.coalesce(seconds_of(hour), F.lit(-1.0)), F.coalesce("indice_linha", F.lit((1 << 53) - 1)), document, F.col("id")]
    return [k.desc_nulls_last() if backwards else k.asc_nulls_first() for k in keys]


#: Filters of a sheet by name.
FILTERS = {
    "prontas": "estado = 'pronta'", "sem_rd": "length(trim(coalesce(remetente_destinatario, ''))) < 3", "sem_pessoa": "pessoa IS NULL",
    "baixa_confianca": f"confianca < {LOW}", "merge_pendente": "estado = 'merge_pendente'", "extracao_duvidosa": "estado = 'extracao_duvidosa'",
}


def filtered(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a sheet that a filter named in FILTERS leaves."""
    return rows.where(FILTERS[name])


def file_summary(lines: DataFrame, origin_rows: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """For each file (arquivo_id, sessao_id and more of files) its live lines, its rows on the sheet, its pages and those to look at.

    A row counts once for each file that one of its lines comes from. pages: arquivo_id, pagina, status, aceitas,
    incertas, motivo; a statement has few.
    """
    live = live_lines(lines).groupBy("arquivo_id").agg(F.count("*").alias("movimentacoes"))
    on_sheet = origin_rows.where("arquivo_id IS NOT NULL").select("fonte", "id", "sessao_id", "arquivo_id").distinct().groupBy("sessao_id", "arquivo_id").agg(F.count("*").alias("linhas_planilha"))
    page = F.struct("pagina", "status", "aceitas", "incertas", "motivo")
    of_pages = pages.groupBy("arquivo_id").agg(F.count_if(F.col("status") == "VERIFICAR").alias("paginas_verificar"), F.array_sort(F.collect_list(page)).alias("paginas"))
    d = files.join(live, "arquivo_id", "left").join(on_sheet, ["sessao_id", "arquivo_id"], "left").join(of_pages, "arquivo_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("movimentacoes", "linhas_planilha", "paginas_verificar")]
    return d.select(*files.columns, *counts, F.coalesce("paginas", F.array().cast("array<struct<pagina:int,status:string,aceitas:int,incertas:int,motivo:string>>")).alias("paginas"))


def session_totals(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """For each session its live lines, the rows of its sheet and those that wait for a merge."""
    live = live_lines(lines).groupBy("sessao_id").agg(F.count("*").alias("movimentacoes_brutas"))
    shown = rows.groupBy("sessao_id").agg(F.count("*").alias("linhas_planilha"), F.count_if(F.col("estado") == "merge_pendente").alias("merges_pendentes"))
    d = live.join(shown, "sessao_id", "full")
    return d.select("sessao_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("movimentacoes_brutas", "linhas_planilha", "merges_pendentes")])


def conflicts(rows: DataFrame) -> DataFrame:
    """For each row what stands in the way: bloqueado, revisar or pronto, and how many findings."""
    found = F.array_compact(F.array(F.when(F.col("pessoa_id").isNull(), "sem_pessoa"), F.when(F.col("bloqueio_export"), "bloqueio"), F.when(F.col("confianca") < LOW, "baixa_confianca")))
    state = F.when(F.col("bloqueio_export"), "bloqueado").when(F.size(found) > 0, "revisar").otherwise("pronto")
    return rows.select("id", state.alias("situacao"), F.array_join(found, ",").alias("achados"), F.size(found).alias("n_achados"))


def rejected_off_sheet(ledger: DataFrame) -> DataFrame:
    """Lines that were absorbed by another and whose main line isn't live, so that no sheet shows them."""
    live = ledger.where("NOT deletado AND canonica_id IS NULL").select(F.col("id").alias("canonica_id"))
    return ledger.where("canonica_id IS NOT NULL").join(live, "canonica_id", "left_anti").select("id", "canonica_id")
