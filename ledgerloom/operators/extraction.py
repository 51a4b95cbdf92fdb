"""From a model's answers about statement pages to ledger rows: items, their fields, two-model consensus and page states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.documents import digits, normalize_cnpj, normalize_cpf, normalize_name
from ledgerloom.functions.fields import amount_br

# The fields of an item that are kept beside the row.
FIELDS = ("data", "valor", "direcao", "descricao", "documento", "historico", "hora", "tipo_pix", "situacao", "saldo", "remetente_destinatario")
ITEM = (*FIELDS, "nome", "contraparte", "cred_dev", "cpf", "cnpj", "cpf_cnpj")
# Words that mark a page without transactions, what is too short to be one, and the score that needs no review.
QUIET_PAGE = r"(?i)(?<![A-Za-z0-9_])(saldo|total|resumo|extrato emitido|período|periodo|agência|agencia|conta corrente|tarifa)(?![A-Za-z0-9_])"
LEAST_TEXT, SURE = 50, 80
BANK_CODE = r"^[A-Z0-9][A-Z0-9\s.\-/]{2,14}$"


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def json_of(answer: Column) -> Column:
    """The JSON part of an answer: what a fence holds, else all from the first bracket on."""
    fence = r"(?is)```(?:json)?\s*(.*?)\s*```"
    return F.when(answer.rlike(fence), F.trim(F.regexp_extract(answer, fence, 1))).otherwise(F.regexp_extract(answer, r"(?s)[\[{].*", 0))


def items_of(answers: DataFrame, *keys: str, content: str = "conteudo") -> DataFrame:
    """keys, indice (from 0), the item's fields as texts, and erro: one row for each item of each answer.

    A bare array counts as transacoes. An answer that isn't JSON, or whose JSON is no object, is a row with erro. An
    amount written as a JSON number keeps its point: it becomes a text with a comma, as statements write it.
    """
    text = json_of(F.coalesce(content, F.lit("")))
    wrapped = F.when(text.startswith("["), F.concat(F.lit('{"transacoes":'), text, F.lit("}"))).otherwise(text)
    whole = F.try_parse_json(wrapped)
    entry = ", ".join(f"{n}: {'variant' if n == 'valor' else 'string'}" for n in ITEM)
    found = F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.from_json(wrapped, f"struct<transacoes: array<struct<{entry}>>>"))
    d = answers.select(*keys, F.when(found.isNull(), "resposta sem JSON").alias("erro"), F.posexplode_outer(found["transacoes"]).alias("indice", "i")).where("erro IS NOT NULL OR i IS NOT NULL")
    raw = F.col("i.valor")
    number = F.when(F.schema_of_variant(raw) != "STRING", F.try_variant_get(raw, "$", "decimal(15,2)"))
    amount = F.coalesce(F.replace(number.cast("string"), F.lit("."), F.lit(",")), F.try_variant_get(raw, "$", "string"))
    return d.select(*keys, "indice", *[amount.alias(n) if n == "valor" else F.col(f"i.{n}").alias(n) for n in ITEM], "erro")


def normalised(items: DataFrame) -> DataFrame:
    """Items with what can be inferred: the counterparty, the bank's code and the document's kind."""
    description = _text("descricao")
    code = description.rlike(BANK_CODE)
    own = F.nullif(_text("remetente_destinatario"), F.lit(""))
    guess = F.when((F.length(description) >= 8) & ~code, description)
    counterparty = F.coalesce(F.when(own.isNotNull(), F.col("remetente_destinatario")), F.nullif(_text("contraparte"), F.lit("")), guess, F.col("remetente_destinatario"))
    said = F.regexp_replace(_text("cred_dev"), "(?i)^null$", "")
    number = digits(F.coalesce("cpf_cnpj", F.lit("")))
    no_cpf, no_cnpj = F.coalesce("cpf", F.lit("")) == "", F.coalesce("cnpj", F.lit("")) == ""
    as_cpf = no_cpf & (F.length(number) == 11)
    return items.withColumns({
        "remetente_destinatario": counterparty,
        "cred_dev": F.coalesce(F.nullif(said, F.lit("")), F.when(code, description), F.col("cred_dev")),
        "cpf": F.when(as_cpf, number).otherwise(F.col("cpf")),
        "cnpj": F.when(~as_cpf & no_cnpj & (F.length(number) == 14), number).otherwise(F.col("cnpj")),
    })


def structured_documents() -> tuple[Column, Column]:
    """An item's CPF and CNPJ from its document fields alone: the first valid one, never one of a free text."""
    cpf, cnpj, either = (digits(F.coalesce(n, F.lit(""))) for n in ("cpf", "cnpj", "cpf_cnpj"))
    sized = lambda c, n, f: F.when(F.length(c) == n, f(c))
    none = F.lit(None).cast("string")
    steps = ((sized(cpf, 11, normalize_cpf), none), (none, sized(cnpj, 14, normalize_cnpj)), (sized(either, 11, normalize_cpf), none), (none, sized(either, 14, normalize_cnpj)))
    found = F.coalesce(*[F.when(F.coalesce(a, b).isNotNull(), F.struct(a.alias("cpf"), b.alias("cnpj"))) for a, b in steps])
    return found["cpf"], found["cnpj"]


def field_map() -> Column:
    """The known fields of an item that say something, trimmed; the amount without sign, with two decimals."""
    values = {n: F.nullif(_text(n), F.lit("")) for n in FIELDS}
    values["valor"] = F.abs(amount_br(F.col("valor"))).cast("decimal(15,2)").cast("string")
    return F.map_filter(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]), lambda k, v: v.isNotNull())


def rows_of(items: DataFrame, *keys: str) -> DataFrame:
    """Ledger rows of normalised items: keys, situacao and the row's fields.

    situacao is linha, or erro for an item with a document that lacks an amount, a direction or a date, or ignorada for
    one without a document and without a name of three characters, an amount or a direction.
    """
    # Columns of their own, so that the check digits are worked out once a row.
    items = items.withColumns(dict(zip(("_cpf", "_cnpj"), structured_documents())))
    cpf, cnpj = F.col("_cpf"), F.col("_cnpj")
    label = F.when(cpf.isNotNull(), F.concat(F.lit("CPF "), cpf)).when(cnpj.isNotNull(), F.concat(F.lit("CNPJ "), cnpj))
    amount, way = amount_br(F.trim("valor")), F.upper(_text("direcao"))
    day = F.when(_text("data").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _text("data").try_cast("date"))
    name, description, party = _text("nome"), _text("descricao"), _text("remetente_destinatario")
    usable = amount.isNotNull() & way.isin("ENTRADA", "SAIDA")
    state = F.when(label.isNull() & ((F.length(party) < 3) | ~usable), "ignorada").when(usable & day.isNotNull(), "linha").otherwise("erro")
    told = F.when((description != "") & (name != "") & F.upper(description).contains(F.upper(name)), description).otherwise(F.concat_ws(" ", F.nullif(description, F.lit("")), F.nullif(name, F.lit(""))))
    with_label = F.trim(F.concat_ws(" ", F.nullif(told, F.lit("")), label))
    raw = F.when(label.isNotNull(), with_label).otherwise(F.coalesce(F.nullif(description, F.lit("")), party))
    number = F.regexp_replace(_text("documento"), "(?i)^null$", "")
    row = {
        "data_movimento": day, "valor": F.abs(amount).cast("decimal(15,2)"), "descricao_raw": raw, "direcao": way, "cred_dev": F.nullif(_text("cred_dev"), F.lit("")),
        "nr_extrato_bancario": F.nullif(F.substring(number, 1, 64), F.lit("")), "remetente_destinatario": F.when(F.length(party) >= 3, normalize_name(party)), "cpf": cpf, "cnpj": cnpj, "campos": field_map(),
    }
    d = items.withColumn("situacao", state)
    return d.select(*keys, "situacao", *[F.when(F.col("situacao") == "linha", c).alias(n) for n, c in row.items()])


def consensus_key() -> Column:
    """Date, cents and direction of an item, or null where one of them is missing."""
    cents = F.abs(F.round(amount_br(F.trim("valor")) * 100)).cast("long")
    good = _text("data").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.upper(_text("direcao")).isin("ENTRADA", "SAIDA") & cents.isNotNull()
    return F.when(good, F.concat_ws("|", _text("data"), cents.cast("string"), F.upper(_text("direcao"))))


def accepted(primary: DataFrame, secondary: DataFrame, scores: DataFrame, page: tuple[str, ...] = ("arquivo_id", "pagina"), order: str = "id") -> DataFrame:
    """What two models read on a page, united: page, order columns id_a and id_b, origem, indice, score and the merged party and documents.

    The k-th item of a key in one reading meets the k-th in the other: consenso, 100 points, with the longer party and
    the second reading's documents where the first has none. All others get the reviewer's score (scores: page, indice,
    score; none is 0); their indices count the first reading's leftovers, then the second's, keys as they first occur.
    """
    def numbered(d: DataFrame, s: str) -> DataFrame:
        keyed = d.withColumn("chave", consensus_key()).where("chave IS NOT NULL")
        w = Window.partitionBy(*page, "chave")
        picked = [F.col(c).alias(f"{c}_{s}") for c in (order, "remetente_destinatario", "cpf", "cnpj")]
        return keyed.select(*page, "chave", F.row_number().over(w.orderBy(order)).alias("k"), F.min(order).over(w).alias(f"primeiro_{s}"), *picked)

    both = numbered(primary, "a").join(numbered(secondary, "b"), [*page, "chave", "k"], "full")
    a, b = F.col(f"{order}_a"), F.col(f"{order}_b")
    origin = F.when(a.isNotNull() & b.isNotNull(), "consenso").when(a.isNotNull(), "primario").otherwise("secundario")
    longer = F.length(F.trim(F.coalesce("remetente_destinatario_b", F.lit("")))) > F.length(F.trim(F.coalesce("remetente_destinatario_a", F.lit(""))))
    merged = {"remetente_destinatario": F.when(longer, F.col("remetente_destinatario_b")).otherwise(F.coalesce("remetente_destinatario_a", "remetente_destinatario_b"))}
    merged |= {c: F.coalesce(F.nullif(f"{c}_a", F.lit("")), f"{c}_b") for c in ("cpf", "cnpj")}
    d = both.select(*page, a.alias("id_a"), b.alias("id_b"), origin.alias("origem"), F.coalesce("primeiro_a", "primeiro_b").alias("_first"), "k", *[c.alias(n) for n, c in merged.items()])
    # A page holds few items.
    w = Window.partitionBy(*page, F.col("origem") == "consenso").orderBy("origem", "_first", "k")
    d = d.withColumn("indice", F.when(F.col("origem") != "consenso", F.row_number().over(w) - 1)).join(scores.select(*page, "indice", "score"), [*page, "indice"], "left")
    return d.withColumn("score", F.when(F.col("origem") == "consenso", 100).otherwise(F.coalesce("score", F.lit(0)))).drop("_first", "k")


def page_states(pages: DataFrame, counts: DataFrame, taken: DataFrame, page: tuple[str, ...] = ("arquivo_id", "pagina")) -> DataFrame:
    """page and estado of every page (pages: page, texto; counts: page, lidas, items of both readings; taken: accepted()).

    NAO_TRANSACIONAL: nothing was read, and the text is short or speaks of balances. OK: something was accepted and
    every score reaches SURE. All others are to be looked at: VERIFICAR.
    """
    best = taken.groupBy(*page).agg(F.min("score").alias("menor"))
    d = pages.join(counts, list(page), "left").join(best, list(page), "left")
    text = F.trim(F.coalesce("texto", F.lit("")))
    quiet = (F.coalesce("lidas", F.lit(0)) == 0) & ((F.length(text) < LEAST_TEXT) | text.rlike(QUIET_PAGE))
    return d.select(*page, F.when(quiet, "NAO_TRANSACIONAL").when(F.col("menor") >= SURE, "OK").otherwise("VERIFICAR").alias("estado"))
