"""Which column of a statement's page holds what: found from the boxes of its texts, checked, and applied to its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.documents import let

#: Height of a band of texts that count as one row, and the gap in x that parts two columns, in the page's units.
BAND, GAP = 15, 20
#: Matches that a row must have to be a header.
LEAST = 2
# What a column's title says for each field; the first field that fits counts.
KEYWORDS = {
    "data": ("data", "dt", "dt.", "movimento", "vencimento"),
    "valor": ("valor", "val", "vlr", "valor (r$)", "valor r$", "vlr (r$)", "vlr r$"),
    "documento": ("documento", "doc", "doc.", "nr. doc", "num doc", "numero doc", "nr doc", "nº documento", "no documento"),
    "cpf_cnpj": ("cpf", "cnpj", "cpf/cnpj", "cpf cnpj", "cpf.cnpj", "cpf_cnpj"),
    "remetente_destinatario": ("remetente", "destinatario", "destinatário", "remetente/destinatario", "favorecido", "nome", "cliente", "origem", "destino", "razao social", "razão social"),
    "historico": ("historico", "desc", "descricao", "historico/descricao", "historico / descricao", "descrição", "histórico"),
    "saldo": ("saldo", "sald", "saldo (r$)", "saldo r$"),
    "situacao": ("situacao", "situação", "status", "estado"),
    "hora": ("hora", "hor.", "time"),
    "tipo_pix": ("tipo de pix", "tipo pix", "tipo_pix", "tipo", "modalidade pix"),
    "direcao": ("cred", "dev", "d/c", "débito", "crédito", "debito", "credito", "cred/dev"),
}
# The fields that every file's map needs, and those that one file of a session must have.
PER_FILE, PER_SESSION = ("data", "valor"), ("remetente_destinatario", "historico", "documento")
#: Fields of a session that a column of another field covers.
COVERED = {"historico": ("tipo_pix",), "documento": ("tipo_pix",)}


def _says(label: Column, field: str) -> Column:
    """Whether a label in small letters holds one of a field's words; words that hold another of them add nothing."""
    words = KEYWORDS[field]
    hit = F.lit(False)
    for word in (w for w in words if not any(o != w and o in w for o in words)):
        hit = hit | label.contains(word)
    return hit


def _field(label: Column) -> Column:
    """The first field that a label in small letters names, or null."""
    field = F.lit(None).cast("string")
    for name in reversed(KEYWORDS):
        field = F.when(_says(label, name), name).otherwise(field)
    return field


def _bands(items: DataFrame, *page: str) -> DataFrame:
    """page, faixa, primeiro (the band's first text by ordem), largura (the greatest of its texts) and colunas: x and titulo
    of each run of texts in a band.

    A run goes on while texts begin at most GAP after its own beginning. Only a band of one page is gathered. Texts are
    dealt by page, so that what is made of a page's bands needs no further shuffle.
    """
    d = items.withColumns({"str": F.trim("str"), "faixa": F.floor(F.col("y") / BAND + 0.5).cast("long")}).repartition(*page)
    bands = d.groupBy(*page, "faixa").agg(F.min("ordem").alias("primeiro"), F.max("largura").alias("largura"), F.sort_array(F.collect_list(F.when(F.col("str") != "", F.struct("x", "ordem", "str")))).alias("t"))
    none = F.array().cast("array<struct<x:double,titulo:string>>")

    def add(runs: Column, t: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        fresh = F.array(F.struct(t["x"].cast("double").alias("x"), t["str"].alias("titulo")))
        longer = F.array(F.struct(last["x"].alias("x"), F.concat_ws(" ", last["titulo"], t["str"]).alias("titulo")))
        return F.when(last.isNull() | (t["x"] - last["x"] > GAP), F.concat(runs, fresh)).otherwise(F.concat(F.slice(runs, 1, F.size(runs) - 1), longer))

    return bands.select(*page, "faixa", "primeiro", "largura", F.aggregate("t", none, add).alias("colunas"))


def header_columns(items: DataFrame, *page: str) -> DataFrame:
    """page, coluna_index, campo, titulo, x_inicio and x_fim: the columns that a page's header names.

    items: the page's columns, ordem, x, y, str and largura (the page's width). The header is the band whose titles fit
    the most fields, the first of equals in ordem; a page without a band of LEAST fits has none. A column reaches half
    way to its neighbours, the outer ones to the page's edges, as shares of its width.
    """
    bands = _bands(items, *page)
    # A title says a field once, and the sum takes one pass over a band's titles.
    hits = lambda low: sum((_says(low, f).cast("int") for f in KEYWORDS), F.lit(0))
    fits = F.aggregate(F.transform("colunas", lambda c: F.lower(c["titulo"])), F.lit(0), lambda n, low: n + hits(low))
    # A page's widest text gives its width, be it in the header's band or not.
    best = bands.withColumn("_n", fits).groupBy(*page).agg(F.max_by("colunas", F.struct("_n", (-F.col("primeiro")).alias("p"))).alias("colunas"), F.max("_n").alias("_n"), F.max("largura").alias("largura")).where((F.col("_n") >= LEAST) & (F.col("largura") > 0))
    d = best.withColumn("_x", F.transform("colunas", lambda c: c["x"] / F.col("largura")))
    # Fields are named before titles become rows: as a column of rows the long CASE would be worked out for a filter and again for the result.
    named = F.transform("colunas", lambda c: F.struct(c["titulo"].alias("titulo"), let(F.lower(c["titulo"]), _field).alias("campo")))
    d = d.select(*page, "_x", F.size("colunas").alias("_m"), F.posexplode(named).alias("coluna_index", "c"))
    at = lambda i: F.get("_x", F.col("coluna_index") + i)
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    left = F.when(F.col("coluna_index") == 0, 0.0).otherwise((at(-1) + at(0)) / 2)
    right = F.when(F.col("coluna_index") == F.col("_m") - 1, 1.0).otherwise((at(0) + at(1)) / 2)
    return d.select(*page, "coluna_index", F.col("c.campo").alias("campo"), F.col("c.titulo").alias("titulo"), clamp(left).alias("x_inicio"), clamp(right).alias("x_fim")).where("campo IS NOT NULL")


def has_direction_header(items: DataFrame, *page: str) -> DataFrame:
    """page and whether any of its bands has a title for the direction."""
    return _bands(items, *page).groupBy(*page).agg(F.bool_or(F.exists("colunas", lambda c: _says(F.lower(c["titulo"]), "direcao"))).alias("coluna_direcao_detectada"))


def map_problems(maps: DataFrame) -> DataFrame:
    """maps with problema, null if the map will do.

    maps: pagina_referencia, inferir_direcao, coluna_direcao_detectada and colunas (campo, coluna_index, ...). A map
    names page 1, columns from 0, a date, an amount, and a direction: the column that was seen, or a column or the sign.
    """
    has = lambda f: F.exists("colunas", lambda c: c["campo"] == f)
    wrong = F.get(F.filter("colunas", lambda c: c["coluna_index"].isNull() | (c["coluna_index"] < 0)), F.lit(0))["campo"]
    seen, inferred = F.coalesce("coluna_direcao_detectada", F.lit(False)), F.coalesce("inferir_direcao", F.lit(False))
    problem = F.when(~F.col("pagina_referencia").eqNullSafe(F.lit(1)), "paginaReferencia deve ser 1").when(wrong.isNotNull(), F.concat(F.lit("colunaIndex inválido para "), wrong))
    for f in PER_FILE:
        problem = problem.when(~has(f), f"Mapeie a coluna {f}")
    problem = problem.when(seen & ~has("direcao"), "Mapeie a coluna direcao").when(~seen & ~has("direcao") & ~inferred, "Mapeie direcao ou marque inferir do valor")
    return maps.withColumn("problema", problem)


def session_problems(maps: DataFrame, session: str = "sessao_id") -> DataFrame:
    """session and problema: the first field that no file of the session maps, null if all are there."""
    fields = F.array_distinct(F.flatten(F.collect_list(F.transform("colunas", lambda c: c["campo"]))))
    d = maps.groupBy(session).agg(fields.alias("_f"))  # distinct names of fields, a map has few
    problem = F.lit(None).cast("string")
    for f in reversed(PER_SESSION):
        covered = F.arrays_overlap("_f", F.array(*[F.lit(x) for x in (f, *COVERED.get(f, ()))]))
        problem = F.when(~covered, f"Falta mapear {f} em pelo menos um extrato").otherwise(problem)
    return d.select(session, problem.alias("problema"))


def field_texts(items: DataFrame, columns: DataFrame, *page: str) -> DataFrame:
    """page, faixa and campos (field to text) of the bands below the header, by the columns that texts begin in.

    columns as from header_columns(); a text belongs to the column whose share of the width holds its beginning.
    """
    d = items.withColumns({"str": F.trim("str"), "faixa": F.floor(F.col("y") / BAND + 0.5).cast("long"), "_s": F.col("x") / F.col("largura")}).where("str <> ''").repartition(*page)
    met = d.join(columns.select(*page, "campo", "x_inicio", "x_fim"), list(page)).where("_s >= x_inicio AND (_s < x_fim OR x_fim = 1)")
    each = met.groupBy(*page, "faixa", "campo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "ordem", "str"))), lambda t: t["str"]), " ").alias("texto"))
    return each.groupBy(*page, "faixa").agg(F.map_from_entries(F.collect_list(F.struct("campo", "texto"))).alias("campos"))
