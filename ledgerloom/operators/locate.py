"""Where a ledger line stands on the pages of its statement: text items to lines, scores, the best line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cells import amount_texts, date_texts, search_amount
from ledgerloom.functions.documents import digits, names_agree, normalize_name, strip_documents
from ledgerloom.operators.storage import written

#: How far an item may lie from the first one of its line.
TOLERANCE = 0.02
# Points for what a page line holds.
BY_DOCUMENT, BY_DATE, BY_AMOUNT, AMOUNT, WORD, NAME, DOCUMENT, NO_DOCUMENT, HOUR = 25, 10, 1, 5, 5, 50, 40, -5, 15


def page_lines(items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """arquivo_id, pagina, linha (from 0, from the top), texto and caixa of text items (arquivo_id, pagina, x, y, width, height, str).

    An item belongs to the line whose first item lies at most tolerance above it. Only one page's items are gathered.
    """
    page = ("arquivo_id", "pagina")
    tops = items.groupBy(*page).agg(F.array_sort(F.collect_set("y")).alias("ys"))
    starts = lambda a, y: F.coalesce(y - F.try_element_at(a, F.lit(-1)) > tolerance, F.lit(True))
    # The first y of each line; a page has few.
    anchors = tops.select(*page, F.aggregate("ys", F.array().cast("array<double>"), lambda a, y: F.when(starts(a, y), F.concat(a, F.array(y))).otherwise(a)).alias("topos"))
    d = items.join(anchors, list(page)).withColumn("linha", F.size(F.filter("topos", lambda a: a <= F.col("y"))) - 1)
    box = [F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("b")]
    lines = d.groupBy(*page, "linha").agg(F.array_sort(F.collect_list(F.struct("x", "y", "str"))).alias("itens"), *box)
    return lines.select(*page, "linha", F.array_join(F.transform("itens", lambda i: i["str"]), " ").alias("texto"), F.struct("x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h")).alias("caixa"))


def words(c: Column) -> Column:
    """Words of two characters or more, in small letters without accents."""
    return F.filter(F.split(F.lower(normalize_name(F.coalesce(c, F.lit("")))), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def _any_in(text: Column, forms: str) -> Column:
    return F.exists(forms, lambda f: text.contains(f))


def _prepared_lines(lines: DataFrame) -> DataFrame:
    """Page lines with what scoring needs of their text, each worked out once: _nome, _palavras, _digitos, _marcas."""
    dates = F.regexp_extract_all(F.col("texto"), F.lit(r"(?=([0-9]{2}/[0-9]{2}))"), F.lit(1))
    ends = F.transform(F.regexp_extract_all(F.col("texto"), F.lit(r"(?=([0-9][.,][0-9]{2}))"), F.lit(1)), lambda e: F.replace(e, F.lit("."), F.lit(",")))
    return lines.withColumns({"_nome": normalize_name(F.col("texto")), "_palavras": words(F.col("texto")), "_digitos": digits(F.col("texto")), "_marcas": F.array_distinct(F.concat(dates, ends))})


def _prepared_wanted(wanted: DataFrame) -> DataFrame:
    """The ledger lines that can be sought, with the forms and keys that they are sought by."""
    w = wanted.withColumn("_valor", search_amount(F.col("valor"))).where("_valor IS NOT NULL AND data_movimento IS NOT NULL")
    w = w.withColumns({"valores": amount_texts(F.col("_valor")), "datas": date_texts(F.col("data_movimento")), "_parte": F.trim(F.coalesce("remetente_destinatario", F.lit("")))})
    end = F.regexp_extract(F.element_at("valores", 3), r"[0-9]\.[0-9]{2}$", 0)
    shaped = "^([0-9]{1,2}):([0-9]{2})"
    hour = F.nullif(F.regexp_extract(F.coalesce("hora", F.lit("")), shaped, 1), F.lit(""))
    return w.select(
        "id", "arquivo_id", "relaxa", "valores", "datas",
        F.array_compact(F.array(F.date_format("data_movimento", "dd/MM"), F.when(F.col("relaxa"), F.replace(end, F.lit("."), F.lit(","))))).alias("_chaves"),
        digits(F.coalesce("documento", F.lit(""))).alias("_documento"), (F.trim(F.coalesce("documento", F.lit(""))) != "").alias("_tem_documento"),
        (F.col("_parte") != "").alias("_tem_parte"), normalize_name(F.col("_parte")).alias("_sua_parte"),
        words(strip_documents(F.concat_ws(" ", F.nullif(F.col("_parte"), F.lit("")), F.nullif(F.trim("descricao_raw"), F.lit(""))))).alias("_procura"),
        F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.regexp_extract("hora", shaped, 2)).alias("_relogio"),
    )


def scores(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every page line that a wanted ledger line may stand on, with its points.

    wanted: id, arquivo_id, data_movimento, valor (text), descricao_raw, remetente_destinatario, documento, hora and
    relaxa (whether the amount alone is enough). Lines of a file are met through what they hold, a day and month or the
    amount's end, never all with all; a line without either can't score. What belongs to one side alone is worked out
    before the sides meet and written down, so that a pair costs comparisons of ready columns; a pair that shares
    several keys is kept under the first of them.
    """
    left, right = written(_prepared_lines(lines), "page_lines"), written(_prepared_wanted(wanted), "wanted")
    met = left.withColumn("_marca", F.explode("_marcas")).join(right.withColumn("_marca", F.explode("_chaves")), ["arquivo_id", "_marca"])
    met = met.where(F.col("_marca") == F.get(F.array_intersect("_chaves", "_marcas"), F.lit(0)))
    text = F.col("texto")
    met = met.withColumns({"_com_valor": _any_in(text, "valores"), "_com_data": _any_in(text, "datas"), "_com_documento": (F.length("_documento") >= 4) & F.col("_digitos").contains(F.col("_documento"))})
    met = met.where("(_com_documento AND _com_data) OR (_com_valor AND (_com_data OR relaxa))")
    silent = ~F.col("_tem_parte") | (F.length("_nome") <= 3) | (F.length("_sua_parte") <= 3)
    met = met.withColumn("_mesmo", F.when(silent, None).otherwise(names_agree(F.col("_nome"), F.col("_sua_parte")))).where("coalesce(_mesmo, true)")
    points = (
        F.when(F.col("_com_documento") & F.col("_com_data"), BY_DOCUMENT).when(F.col("_com_data"), BY_DATE).otherwise(BY_AMOUNT)
        + F.when(F.col("_com_valor"), AMOUNT).otherwise(0) + F.size(F.filter("_palavras", lambda t: F.array_contains("_procura", t))) * WORD + F.when(F.col("_mesmo"), NAME).otherwise(0)
        + F.when(~F.col("_tem_documento"), 0).when(F.col("_com_documento"), DOCUMENT).when(F.col("relaxa"), 0).otherwise(NO_DOCUMENT)
        + F.when(F.coalesce(text.contains(F.col("_relogio")), F.lit(False)), HOUR).otherwise(0)
    )
    return met.select("id", "arquivo_id", "pagina", "linha", "caixa", points.alias("pontos"))


def _why(found: Column) -> Column:
    return F.when(search_amount(F.col("valor")).isNull(), "Valor inválido").when(F.col("data_movimento").isNull(), "Data inválida").when(~found, "Nenhuma linha com valor e data na mesma linha")


def located(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, pagina, caixa, pontos and motivo for every wanted line: the best page line, the first of equals, or why there is none."""
    at = F.struct((-F.col("pontos")).alias("p"), "pagina", "linha")
    best = scores(lines, wanted).where("pontos >= 1").groupBy("id").agg(F.min_by(F.struct("pagina", "caixa", "pontos"), at).alias("b"))
    return wanted.join(best, "id", "left").select("id", "b.pagina", "b.caixa", "b.pontos", _why(F.col("b").isNotNull()).alias("motivo"))


def anchored(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, pagina, caixa, pontos, ancoragem and motivo of wanted lines, which also have their declared pagina and whether they are
    anchored already (ancorada: these are left out).

    The pages that any sought line of a file declares are searched first, all pages for lines that these do not hold.
    Both searches are one: each page line is scored once and those on declared pages stand before the rest. A line that
    is nowhere keeps its declared page, loses its box and is nao_localizado.
    """
    sought = wanted.where("NOT coalesce(ancorada, false)").withColumnRenamed("pagina", "_declarada")
    pages = sought.where("_declarada >= 1").select("arquivo_id", F.col("_declarada").alias("pagina")).distinct().withColumn("_dita", F.lit(True))
    found = scores(lines, sought).where("pontos >= 1").join(pages, ["arquivo_id", "pagina"], "left")
    at = F.struct(F.col("_dita").isNull().alias("d"), (-F.col("pontos")).alias("p"), "pagina", "linha")
    best = found.groupBy("id").agg(F.min_by(F.struct("pagina", "caixa", "pontos"), at).alias("b"))
    d = sought.join(best, "id", "left")
    there = F.col("b").isNotNull()
    return d.select("id", F.coalesce("b.pagina", "_declarada").alias("pagina"), "b.caixa", "b.pontos", F.when(there, "text_layer").otherwise("nao_localizado").alias("ancoragem"), _why(there).alias("motivo"))
