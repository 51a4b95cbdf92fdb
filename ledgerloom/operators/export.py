"""Exports: fan-out to the three documents, XML fragments, documents and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fields import csv_cell


def _escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def element(name: str, value: Column) -> Column:
    """An element, or nothing where the value is null or empty."""
    text = _escaped(value.cast("string"))
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))).otherwise("")


def fan_out(ledger: DataFrame, classes: DataFrame) -> DataFrame:
    """id and documento: ENTRADA lines go to origem, those with a receipt to doacao too, all others to aplicacao."""
    d = ledger.join(classes.select(F.col("movimentacao_id").alias("id"), "nr_recibo_doacao"), "id", "left")
    incoming = F.col("direcao") == "ENTRADA"
    to = F.array_compact(F.array(F.when(incoming, "origem").otherwise("aplicacao"), F.when(incoming & (F.coalesce("nr_recibo_doacao", F.lit("")) != ""), "doacao")))
    return d.select("id", "valor", F.explode(to).alias("documento"))


def origin_items(ledger: DataFrame, classes: DataFrame, people: DataFrame) -> DataFrame:
    """id and the origem fragment of every incoming, confirmed and classified line; the receipt stands before the summary, as the schema wants."""
    d = ledger.where("direcao = 'ENTRADA' AND status = 'CONFIRMADO'").join(classes.withColumnRenamed("movimentacao_id", "id"), "id")
    d = d.join(people.where("tipo = 'PF'").select("pessoa_id", "documento", "nome"), "pessoa_id", "left")
    parts = [element("fonteRecurso", F.col("fonte_recurso")), element("dataMovimento", F.col("data_movimento")), element("valor", F.col("valor").cast("decimal(15,2)")), element("nrRecibo", F.col("nr_recibo_doacao")), element("cpf", F.col("documento")), element("nome", F.col("nome")), element("resumo", F.col("descricao_raw"))]
    return d.select("id", "cnpj_prestador", "exercicio", "data_movimento", F.concat(F.lit("<origem>"), *parts, F.lit("</origem>")).alias("xml"))


def origin_document(items: DataFrame, cnpj: str, year: int) -> DataFrame:
    """The whole document of one filing entity and year, as lines by date and id: it is written by one sorted pass, never gathered in one value."""
    own = items.where((F.col("cnpj_prestador") == cnpj) & (F.col("exercicio") == year))
    safe = cnpj.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("%", "%%")
    no_date = F.lit(None).cast("date").alias("data_movimento")
    total = own.agg(F.count("*").alias("n"))
    head = total.select(F.lit(0).alias("part"), no_date, F.lit(0).cast("long").alias("id"), F.format_string(f"<prestacao><cabecalho><nrCnpjPrestador>{safe}</nrCnpjPrestador><anoExercicio>{year}</anoExercicio></cabecalho><corpo><origens><totalOrigem>%d</totalOrigem>", "n").alias("xml"))
    tail = total.select(F.lit(2).alias("part"), no_date, F.lit(0).cast("long").alias("id"), F.lit("</origens></corpo></prestacao>").alias("xml"))
    return head.union(own.select(F.lit(1), "data_movimento", F.col("id").cast("long"), "xml")).union(tail).orderBy("part", "data_movimento", "id").select("xml")


# A document's element by its type, and the forms and operations of a donation by the kind of money.
DOCUMENT_TAGS = {"BOLETO": "boleto", "CONTRATO": "contrato", "FISCAL": "fiscal", "FATURA": "fatura", "RECIBO": "recibo", "OUTRO": "outro"}
DONATION_FORMS, OPERATIONS = ("PIX", "TED", "TEL", "TEB", "CH"), ("PIX", "TED", "TEL", "EP")
# What stands where a line names none.
NO_SPENDING_CODE, NO_DOCUMENT_TYPE, NO_SITUATION, NO_SOURCE, NO_KIND = "401", "RECIBO", 1, "OR", "PIX"


def node(name: str, *parts: Column) -> Column:
    """An element that holds other elements."""
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


def _money(c: Column) -> Column:
    return c.cast("decimal(15,2)")


def application_items(ledger: DataFrame, classes: DataFrame, people: DataFrame) -> DataFrame:
    """id, scope, xml and erro: the gasto fragment of every outgoing, confirmed and classified line.

    people has tipo, pessoa_id, documento and nome; the ledger pessoa_id and pessoa_juridica_id, of which the company
    comes first. A line without either has no xml but an erro, which a writer must check.
    """
    d = ledger.where("direcao = 'SAIDA' AND status = 'CONFIRMADO'").join(classes.withColumnRenamed("movimentacao_id", "id"), "id")
    for kind, key in (("PF", "pessoa_id"), ("PJ", "pessoa_juridica_id")):
        d = d.join(people.where(F.col("tipo") == kind).select(F.col("pessoa_id").alias(key), F.struct("documento", "nome").alias(kind)), key, "left")
    company = node("pessoaJuridica", element("nrCnpj", F.col("PJ.documento")), element("nmPessoa", F.col("PJ.nome")))
    person = node("pessoaFisica", element("nrCpf", F.col("PF.documento")), element("nmPessoa", F.col("PF.nome")))
    told = F.coalesce("descricao_resumida", "descricao_raw")
    document = F.concat(element("nrDocumento", F.col("nr_documento")), element("dataEmissaoContratacao", F.coalesce("data_emissao", "data_movimento")), element("vrTotalDocumento", _money(F.col("valor"))))
    tipo = F.upper(F.coalesce("tipo_documento", F.lit(NO_DOCUMENT_TYPE)))
    tagged = node("recibo", document)
    for kind, tag in DOCUMENT_TAGS.items():
        tagged = F.when(tipo == kind, node(tag, *([element("descricao", F.substring(told, 1, 20))] if tag == "outro" else []), document)).otherwise(tagged)
    situation = F.when(F.coalesce("detalhe_situacao", F.lit(NO_SITUATION)) == 1, node("situacao1", element("descricaoResumida", told))).otherwise("")
    spent = node("classificacaoGasto", node("gastoContaContabil", element("cdDescricaoGasto", F.coalesce("cd_gasto", F.lit(NO_SPENDING_CODE))), element("vrGasto", _money(F.col("valor"))), situation))
    who = F.when(F.col("PJ").isNotNull(), company).when(F.col("PF").isNotNull(), person)
    xml = node("gasto", node("pessoa", who), node("dadosDocumento", tagged), spent)
    return d.select("id", "cnpj_prestador", "exercicio", "data_movimento", xml.alias("xml"), F.when(who.isNull(), "sem pessoa").alias("erro"))


def donation_items(ledger: DataFrame, classes: DataFrame, people: DataFrame, links: DataFrame) -> DataFrame:
    """id, scope, xml and erro: the doacao fragment of every incoming, confirmed, classified line with a synced link.

    links has movimentacao_id and sincronizado; the ledger uf_sigla, nr_extrato_bancario and conta (agencia, conta, dv, or
    null). A line whose person or receipt is missing has no xml but an erro.
    """
    linked = links.where("sincronizado").select(F.col("movimentacao_id").alias("id"))
    d = ledger.where("direcao = 'ENTRADA' AND status = 'CONFIRMADO'").join(linked, "id").join(classes.withColumnRenamed("movimentacao_id", "id"), "id")
    d = d.join(people.where("tipo = 'PF'").select("pessoa_id", F.struct("documento", "nome").alias("PF")), "pessoa_id", "left")
    money, receipt = _money(F.col("valor")), F.nullif("nr_recibo_doacao", F.lit(""))
    kind = F.upper(F.coalesce("especie_recurso", F.lit(NO_KIND)))
    number = F.coalesce("nr_extrato_bancario", "nr_recibo_doacao", F.lit("0"))
    party = node("beneficiario", node("partido", element("tipo", F.lit("PP")), element("nrCnpj", F.col("cnpj_prestador")), element("esferaPartidaria", F.lit("ESTADUAL")), element("eleicao", F.col("exercicio")), element("eleicaoSuplementar", F.lit("N")), element("partido", F.col("partido")), element("uf", F.upper("uf_sigla"))))
    donor = node("doadoresOriginarios", node("dadorOriginario", node("pessoaFisica", element("nrCpf", F.col("PF.documento")), element("nmPessoa", F.col("PF.nome")), element("nrReciboDoacao", receipt), element("vrDoacao", money))))
    account = F.col("conta")
    to = node("contaBancariaDestino", node("bancoDestino", element("nrBancoOrigem", F.lit("000")), element("agenciaOrigem", F.coalesce(account["agencia"], F.lit("0000"))), element("contaCorrente", F.coalesce(account["conta"], F.lit("0"))), element("dvContaCorrente", F.coalesce(account["dv"], F.lit("0")))))
    body = [
        party, element("dtDoacao", F.col("data_movimento")), element("fonteRecurso", F.coalesce("fonte_recurso", F.lit(NO_SOURCE))), node("classificacoesDoacao", element("valorDoacao", money)),
        element("formaDoacao", F.when(kind.isin(*DONATION_FORMS), kind).otherwise(NO_KIND)), element("operacaoFinanceira", F.when(kind.isin(*OPERATIONS), kind)),
        element("nrExtratoBancario", number), F.lit("<contaBancariaOrigem></contaBancariaOrigem>"), element("nrDocumento", number), element("nrReciboDoacao", receipt), donor, to,
    ]
    error = F.when(F.col("PF").isNull(), "sem pessoa").when(receipt.isNull(), "sem recibo")
    return d.select("id", "cnpj_prestador", "exercicio", "data_movimento", F.when(error.isNull(), node("doacao", *body)).alias("xml"), error.alias("erro"))


# The columns of the approved list's file.
APPROVED_COLUMNS = ("id", "data_movimento", "valor", "direcao", "pessoa_nome", "pessoa_documento", "cnpj_prestador", "prestador_nome", "descricao_raw", "uf", "status", "sessao_prestacao_id", "confianca_global", "nome_arquivo", "cred_dev")


def approved_file(rows: DataFrame) -> DataFrame:
    """parte and value: the approved list as CSV lines, newest first, headed by a byte order mark and the names.

    Columns that rows lack are empty. Write value as text with the line separator CR LF, in the order given.
    """
    cells = [csv_cell(F.col(c)) if c in rows.columns else F.lit("") for c in APPROVED_COLUMNS]
    head = rows.sparkSession.range(1).select(F.lit(0).alias("parte"), F.lit(None).cast("date").alias("d"), F.lit(None).cast(rows.schema["cnpj_prestador"].dataType).alias("c"), F.lit(None).cast(rows.schema["id"].dataType).alias("i"), F.lit("\ufeff" + ",".join(APPROVED_COLUMNS)).alias("value"))
    body = rows.select(F.lit(1), "data_movimento", "cnpj_prestador", "id", F.concat_ws(",", *cells))
    return head.union(body).orderBy("parte", F.desc("d"), "c", "i").select("parte", "value")


def csv_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """value: one CSV line for each row, in order; write it as text."""
    return df.orderBy(*order).select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in df.columns]).alias("value"))


# Sheets of the audit workbook, their titles, and the columns behind those that aren't of that name.
MIRROR = {
    "Origem": ("data", "valor", "direcao", "descricao", "cred_dev", "fonte_recurso", "natureza_recurso", "tipo_origem_recurso", "classificacao_receita"),
    "Aplicacao": ("data", "valor", "direcao", "descricao", "cred_dev", "cd_descricao_gasto", "tipo_documento", "nr_documento"),
    "Doacao": ("data", "valor", "descricao", "nr_recibo_doacao"),
}
MIRRORED = {"data": "data_movimento", "descricao": "descricao_raw"}


def text_cells(*columns: Column) -> Column:
    """An array of text cells; nulls are empty texts."""
    return F.array(*[F.struct(F.lit("texto").alias("tipo"), F.coalesce(c.cast("string"), F.lit("")).alias("texto")) for c in columns])


#: The order in which rows of mirror_rows() and approved_rows() are written.
BOOK_ORDER = ("_folha", "_parte", "_chave")


def _titled(rows: DataFrame, books: DataFrame, sheet: str, at: int, titles: tuple[str, ...]) -> DataFrame:
    """rows (arquivo, _chave, celulas) of one sheet under its titles, which every workbook gets."""
    head = books.select("arquivo", F.lit(None).cast(rows.schema["_chave"].dataType).alias("_chave"), text_cells(*map(F.lit, titles)).alias("celulas"), F.lit(0).alias("_parte"))
    return head.unionByName(rows.withColumn("_parte", F.lit(1))).withColumns({"planilha": F.lit(sheet), "_folha": F.lit(at)})


def mirror_rows(ledger: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the audit workbooks, one workbook for each filing entity and year: arquivo, planilha, celulas and BOOK_ORDER.

    Confirmed lines with their classification, if any: incoming ones in Origem, those of them with a receipt in Doacao
    too, all others in Aplicacao; by date and id.
    """
    d = ledger.where("status = 'CONFIRMADO'").join(classes.withColumnRenamed("movimentacao_id", "id"), "id", "left")
    d = d.withColumn("arquivo", F.concat_ws("_", F.lit("espelho"), F.col("cnpj_prestador").cast("string"), F.concat(F.col("exercicio").cast("string"), F.lit(".xlsx"))))
    books = d.select("arquivo").distinct()
    of = {"Origem": "direcao = 'ENTRADA'", "Aplicacao": "direcao IS DISTINCT FROM 'ENTRADA'", "Doacao": "direcao = 'ENTRADA' AND nr_recibo_doacao <> ''"}
    sheets = [_titled(d.where(of[s]).select("arquivo", F.struct("data_movimento", "id").alias("_chave"), text_cells(*[F.col(MIRRORED.get(t, t)) for t in titles]).alias("celulas")), books, s, k, titles) for k, (s, titles) in enumerate(MIRROR.items())]
    return sheets[0].unionByName(sheets[1]).unionByName(sheets[2])


def approved_rows(rows: DataFrame, *by: str, titles: tuple[str, ...] = APPROVED_COLUMNS) -> DataFrame:
    """Rows of workbooks of approved lines, one for each value of by, with one sheet; newest first, then by filing entity and id.

    Columns that rows lack are empty.
    """
    d = rows.withColumn("arquivo", F.concat(F.concat_ws("_", F.lit("movimentacoes"), *[F.col(c).cast("string") for c in by]), F.lit(".xlsx")))
    key = F.struct((-F.unix_date("data_movimento")).alias("dia"), "cnpj_prestador", "id")
    lines = d.select("arquivo", key.alias("_chave"), text_cells(*[F.col(t) if t in rows.columns else F.lit("") for t in titles]).alias("celulas"))
    return _titled(lines, d.select("arquivo").distinct(), "Movimentacoes", 0, titles)


# The element of each kind of money, those that say where it arrived, and what stands for an unknown account.
MONEY_TAGS = {
    "PIX": "transferenciaEletronicaPIX", "TED": "transferenciaEletronicaTED", "TEL": "transferenciaEletronicaTEL", "TEB": "transferenciaEletronicaTEB", "CH": "depositoCheque",
    "EP": "depositoEspecie", "OB": "ordemBancaria", "CC": "cartaoCredito", "AC": "avisoCredito", "OT": "outrosTitulosCredito",
}
WITHOUT_ACCOUNT = ("OT",)
NO_BANK, NO_AGENCY, NO_ACCOUNT, NO_CHECK = "000", "0000", "0", "0"


def slot(name: str, value: Column) -> Column:
    """An element that is there though its value is missing."""
    found = element(name, value)
    return F.when(found == "", f"<{name}/>").otherwise(found)


def origin_fragments(ledger: DataFrame, classes: DataFrame, people: DataFrame, accounts: DataFrame) -> DataFrame:
    """id, scope, xml and erro: the whole origem fragment of every incoming, confirmed and classified line.

    ledger: pessoa_id, pessoa_juridica_id, conta_id, nr_extrato_bancario and the line's own columns; classes:
    movimentacao_id, fonte_recurso, natureza_recurso, tipo_origem_recurso, classificacao_receita, descricao_resumida,
    nr_recibo_doacao, especie_recurso; people: tipo, pessoa_id, documento, nome, titulo_eleitor; accounts: conta_id,
    agencia, conta, dv. The receipt stands before the summary, as the schema wants. An unknown kind of money counts as
    PIX under its own name. Elements that the schema wants are there though empty. A line without the person that its origin's type names, or with a type that is neither PF
    nor PJ, has no xml but an erro.
    """
    d = ledger.where("direcao = 'ENTRADA' AND status = 'CONFIRMADO'").join(classes.withColumnRenamed("movimentacao_id", "id"), "id")
    for kind, key in (("PF", "pessoa_id"), ("PJ", "pessoa_juridica_id")):
        d = d.join(people.where(F.col("tipo") == kind).select(F.col("pessoa_id").alias(key), F.struct("documento", "nome", "titulo_eleitor").alias(kind)), key, "left")
    d = d.join(accounts.select("conta_id", F.struct("agencia", "conta", "dv").alias("_conta")), "conta_id", "left")
    kind, money = F.upper(F.coalesce("tipo_origem_recurso", F.lit("PF"))), F.upper(F.coalesce("especie_recurso", F.lit(NO_KIND)))
    person = node("pessoaFisica", element("tipo", F.lit("PF")), slot("nrCpf", F.col("PF.documento")), slot("nmPessoa", F.col("PF.nome")), element("tituloEleitor", F.col("PF.titulo_eleitor")))
    company = node("pessoaJuridica", element("tipo", F.lit("PJ")), slot("nrCnpj", F.col("PJ.documento")), slot("nmPessoa", F.col("PJ.nome")))
    known = F.col("_conta").isNotNull()
    of_account = lambda name, c, none: slot(name, F.when(known, F.coalesce(c, F.lit(none)) if name == "dvContaCorrente" else c).otherwise(none))
    bank = node("contaBancariaDestino", node("bancoDestino", slot("nrBancoDestino", F.lit(NO_BANK)), of_account("agenciaDestino", F.col("_conta.agencia"), NO_AGENCY), of_account("contaCorrente", F.col("_conta.conta"), NO_ACCOUNT), of_account("dvContaCorrente", F.col("_conta.dv"), NO_CHECK)))
    tag = F.lit(MONEY_TAGS[NO_KIND])
    for name, element_name in MONEY_TAGS.items():
        tag = F.when(money == name, element_name).otherwise(tag)
    arrived = F.when(money.isin(*WITHOUT_ACCOUNT), "").otherwise(bank)
    spoken = F.concat(F.lit("<especieRecurso><"), tag, F.lit(">"), element("especieRecurso", money), element("nrExtratoBancario", F.col("nr_extrato_bancario")), arrived, F.lit("</"), tag, F.lit("></especieRecurso>"))
    xml = node(
        "origem", slot("dtEntrada", F.col("data_movimento")), slot("vrOrigem", _money(F.col("valor"))), slot("fonteRecurso", F.col("fonte_recurso")), slot("naturezaRecurso", F.col("natureza_recurso")),
        node("origemRecurso", F.when(kind == "PF", person).when(kind == "PJ", company)), slot("classificacaoReceita", F.col("classificacao_receita")), element("nrReciboDoacao", F.col("nr_recibo_doacao")),
        element("descricaoResumida", F.col("descricao_resumida")), spoken,
    )
    error = F.when((kind == "PF") & F.col("PF").isNull(), "sem pessoa física").when((kind == "PJ") & F.col("PJ").isNull(), "sem pessoa jurídica").when(~kind.isin("PF", "PJ"), F.concat(F.lit("tipo de origem: "), kind))
    return d.select("id", "cnpj_prestador", "exercicio", "data_movimento", F.when(error.isNull(), xml).alias("xml"), error.alias("erro"))
