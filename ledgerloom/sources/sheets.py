"""Statements and person registries in spreadsheets: what rows of cells (arquivo, linha, celulas) say.

Cells come from workbooks (xlsx.read) or from CSV files (csv_cells). Files are many and each has its own header, so
headers are columns of a small table that is joined back, and no file is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.cells import person_type, prepared_document, text_cell
from ledgerloom.functions.documents import normalize_cnpj, normalize_cpf, normalize_name
from ledgerloom.functions.fields import header_key
from ledgerloom.operators.storage import written
from ledgerloom.sources.xlsx import CELL

# The columns of a statement, and the words for its two directions.
REQUIRED, OPTIONAL = ("data", "descricao", "valor"), "tipo"
INCOMING, OUTGOING = ("C", "CREDITO", "CRÉDITO", "ENTRADA"), ("D", "DEBITO", "DÉBITO", "SAIDA", "SAÍDA")
# Header keys that name each field of a registry.
ALIASES = {
    "tipo": ("tipo", "type", "pf_pj", "pessoa", "pessoa_tipo", "tipo_pessoa"),
    "documento": ("documento", "doc", "cpf", "cnpj", "cpf_cnpj", "cpfcnpj", "nr_cpf_cnpj", "cnpj_cpf", "doc_cpf_cnpj", "documento_cpf_cnpj", "nr_documento", "n_documento", "no_documento", "num_documento", "numero_documento"),
    "nome": ("nome", "name", "razao_social", "razao", "nome_completo", "nome_razao", "nome_razao_social"),
}
FIELDS = ("tipo", "documento", "nome")


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """arquivo, linha and celulas of the CSV files under a path; a quote is a character like any other.

    Each file's separator is the semicolon if its first line has more of them than commas, else the comma. Blank lines
    are left out and not counted. Lines are numbered from 1 in the file's order, however many splits it is read in:
    by their place within a split, after all lines of the splits before it.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(F.col("value").alias("texto"), meta["file_path"].alias("arquivo"), meta["file_block_start"].alias("_bloco")).withColumn("_lugar", F.monotonically_increasing_id())
    lines = lines.withColumn("texto", F.regexp_replace(F.when(F.col("_bloco") == 0, F.regexp_replace("texto", "^\\x{FEFF}", "")).otherwise(F.col("texto")), "\\r$", "")).where(F.trim("texto") != "")
    split = ("arquivo", "_bloco")
    before = lines.groupBy(*split).agg(F.count("*").alias("n")).withColumn("_antes", F.sum("n").over(Window.partitionBy("arquivo").orderBy("_bloco").rowsBetween(Window.unboundedPreceding, -1)))
    placed = lines.withColumn("_k", F.row_number().over(Window.partitionBy(*split).orderBy("_lugar"))).join(before.drop("n"), list(split))
    placed = placed.select("arquivo", (F.coalesce("_antes", F.lit(0)) + F.col("_k")).alias("linha"), "texto")
    count = lambda c: F.length("texto") - F.length(F.replace("texto", F.lit(c)))
    separators = placed.where("linha = 1").select("arquivo", F.when(count(";") > count(","), ";").otherwise(",").alias("_sep"))
    plain = F.when(F.col("_sep") == ";", F.split("texto", ";")).otherwise(F.split("texto", ","))
    cells = F.transform(plain, lambda t: F.struct(F.lit("texto").alias("tipo"), t.alias("texto")).cast(CELL))
    return placed.join(separators, "arquivo").select("arquivo", "linha", cells.alias("celulas"))


def _texts(cells: str | Column) -> Column:
    return F.transform(cells, lambda c: F.coalesce(F.trim(c["texto"]), F.lit("")))


def _at(index: Column | str) -> Column:
    """The cell at an index, null where there is none."""
    i = F.col(index) if isinstance(index, str) else index
    return F.when(i >= 0, F.get("celulas", i))


def _file_error(heads: DataFrame) -> DataFrame:
    return heads.where("_erro IS NOT NULL").select("arquivo", F.lit(None).cast("long").alias("linha"), F.col("_erro").alias("erro"))


def amount_of(cell: Column) -> Column:
    """A statement's amount as a double: a number as it is; of a text with points and commas the comma is the decimal one,
    and what follows the number is left out. Null if there is no number."""
    text = F.trim(cell["texto"])
    plain = F.when(text.contains(",") & text.contains("."), F.regexp_replace(F.replace(text, F.lit(".")), "^([^,]*),", "$1.")).otherwise(F.regexp_replace(text, "^([^,]*),", "$1."))
    number = F.regexp_extract(plain, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(cell["tipo"] == "numero", text.try_cast("double")).otherwise(F.nullif(number, F.lit("")).try_cast("double"))


def day_of(cell: Column) -> Column:
    """A date cell's day, or that of a text dd/mm/yyyy, yyyy-mm-dd or dd-mm-yyyy; null if there is no such day."""
    text = F.trim(cell["texto"])
    part = lambda shape, k: F.regexp_extract(text, shape, k)
    local = r"^([0-9]{2})[/-]([0-9]{2})[/-]([0-9]{4})$"
    iso = F.when(text.rlike("^[0-9]{2}([/-])[0-9]{2}\\1[0-9]{4}$"), F.concat_ws("-", part(local, 3), part(local, 2), part(local, 1))).when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text)
    return F.when(cell["tipo"] == "data", F.substring(text, 1, 10)).otherwise(iso).try_cast("date")


def statement_rows(cells: DataFrame) -> DataFrame:
    """arquivo, linha, data_movimento, valor, direcao, descricao_raw and erro of statements' rows (first sheets only).

    A file's first row with cells names the columns, in any case; of two of one name the last counts. Rows blank in those
    columns are left out. The direction comes from tipo, or without one from the sign. A row that can't be read has its
    erro and no values; a file without a required column gives one row with its erro and no linha. An ingest takes a file
    whole or not at all: see refused().
    """
    # Written, so that a workbook is taken apart once, though its titles and its rows are asked for apart.
    cells = written(cells.select("arquivo", "linha", "celulas").where("celulas IS NOT NULL"), "cells")
    names = (*REQUIRED, OPTIONAL)
    first = cells.groupBy("arquivo").agg(F.min_by(F.struct(F.col("linha").alias("_inicio"), _texts("celulas").alias("_titulos")), "linha").alias("h")).select("arquivo", "h.*")
    keys = F.reverse(F.transform("_titulos", lambda t: F.lower(t)))
    heads = first.select("arquivo", "_inicio", *[(F.size("_titulos") - F.nullif(F.array_position(keys, n), F.lit(0))).cast("int").alias(f"_{n}") for n in names])
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), n) for n in REQUIRED]))
    heads = heads.withColumn("_erro", F.when(F.size(missing) > 0, F.concat(F.lit("Colunas obrigatórias ausentes: "), F.array_join(missing, ", "))))
    d = cells.join(heads.where("_erro IS NULL"), "arquivo").where("linha > _inicio").select("arquivo", "linha", *[_at(f"_{n}").alias(n) for n in names])
    said = lambda n: F.trim(F.coalesce(F.col(n)["texto"], F.lit("")))
    d = d.where(" OR ".join(f"trim(coalesce({n}.texto, '')) <> ''" for n in names))
    amount, kind = amount_of(F.col("valor")), F.upper(said("tipo"))
    way = F.when(kind == "", F.when(amount >= 0, "ENTRADA").otherwise("SAIDA")).when(kind.isin(*INCOMING), "ENTRADA").when(kind.isin(*OUTGOING), "SAIDA")
    day = day_of(F.col("data"))
    error = F.when(amount.isNull(), F.concat(F.lit("Valor inválido: "), F.coalesce(F.nullif(said("valor"), F.lit("")), F.lit("vazio")))).when(way.isNull(), F.concat(F.lit("Tipo inválido: "), said("tipo"))).when(day.isNull(), F.concat(F.lit("Data inválida: "), said("data")))
    d = d.select("arquivo", "linha", error.alias("erro"), day.alias("_dia"), F.abs(amount).cast("decimal(15,2)").alias("_valor"), way.alias("_direcao"), said("descricao").alias("_descricao"))
    good = lambda c: F.when(F.col("erro").isNull(), F.col(c))
    d = d.select("arquivo", "linha", good("_dia").alias("data_movimento"), good("_valor").alias("valor"), good("_direcao").alias("direcao"), good("_descricao").alias("descricao_raw"), "erro")
    return d.unionByName(_file_error(heads), allowMissingColumns=True)


def refused(rows: DataFrame) -> DataFrame:
    """arquivo, linha and erro of the files that an ingest refuses: the first error of each."""
    return rows.where("erro IS NOT NULL").groupBy("arquivo").agg(F.min_by(F.struct("linha", "erro"), F.coalesce("linha", F.lit(0))).alias("e")).select("arquivo", "e.*")


def _document_valid(tipo: Column, document: Column) -> Column:
    return F.when(tipo == "PF", normalize_cpf(document, strict=False)).when(tipo == "PJ", normalize_cnpj(document))


def registry_heads(cells: DataFrame, column_map: dict[str, str] | None = None, headerless: bool = True) -> DataFrame:
    """For each file where its fields stand: arquivo, _tipo, _documento, _nome (indices), sem_cabecalho, _colunas and _erro.

    Headers are those of row 1, found by the map's names or by ALIASES (the first column of each). With headerless, a
    first row of two values or more that names neither documento nor nome and holds a document is a person: the columns
    are name, document and type, or document first if its first two cells say so.
    """
    if column_map is not None and not (column_map.get("documento") and column_map.get("nome")):
        raise ValueError("a column map names documento and nome")
    titles = cells.where("linha = 1 AND celulas IS NOT NULL").select("arquivo", F.posexplode(_texts("celulas")).alias("i", "t"))
    known = F.create_map(*[F.lit(x) for f, names in ALIASES.items() for n in names for x in (n, f)])
    # One row for each title; what a document cell needs is worked out once and written down.
    titles = written(titles.withColumns({"k": header_key(F.col("t")), "d": prepared_document(F.col("t")), "texto": text_cell(F.col("t"))}), "titles")
    titles = titles.withColumn("doc", F.coalesce(_document_valid(F.col("d.tipo"), F.col("d.documento")).isNotNull(), F.lit(False)))
    titles = titles.withColumns({"campo": F.try_element_at(known, "k"), "pessoa": (F.length("texto") >= 2) & ~F.col("doc") & F.col("t").rlike("[A-Za-zÀ-ÿ]")})
    here = lambda i, what: F.coalesce(F.bool_or((F.col("i") == i) & F.col(what)), F.lit(False))
    place = {f: F.min(F.when(F.col("campo") == f, F.col("i"))) for f in FIELDS}
    wanted = {f: name for f in FIELDS if (name := (column_map or {}).get(f))}
    mapped = {f: F.min(F.when((F.col("t") == name.strip()) | (F.col("k") == header_key(F.lit(name))), F.col("i"))) for f, name in wanted.items()}
    facts = titles.groupBy("arquivo").agg(
        F.max(F.when(F.col("t") != "", F.col("i") + 1)).alias("_colunas"), F.count_if(F.col("t") != "").alias("_valores"), F.bool_or(F.col("doc")).alias("_documentado"), (here(0, "doc") & here(1, "pessoa")).alias("_virada"),
        *[c.alias(f"_a_{f}") for f, c in place.items()], *[c.alias(f"_m_{f}") for f, c in mapped.items()],
    )
    d = cells.select("arquivo").distinct().join(facts, "arquivo", "left")
    person = (F.col("_valores") >= 2) & F.col("_a_documento").isNull() & F.col("_a_nome").isNull() & F.col("_documentado")
    d = d.withColumns({"sem_cabecalho": F.coalesce(person, F.lit(False)) if headerless else F.lit(False), "_colunas": F.coalesce("_colunas", F.lit(0))})
    if column_map:
        error = F.coalesce(*[F.when(F.col(f"_m_{f}").isNull(), f"Coluna mapeada não encontrada: {wanted[f]} ({f})") for f in ("documento", "nome", "tipo") if f in wanted])
    else:
        missing = F.array_compact(F.array(*[F.when(F.col(f"_a_{f}").isNull(), f) for f in ("documento", "nome")]))
        error = F.when(F.size(missing) > 0, F.concat(F.lit("Colunas obrigatórias ausentes: "), F.array_join(missing, ", "), F.lit(". Mapeie manualmente.")))
    found = {f: (F.col(f"_m_{f}") if f in wanted else F.lit(None)) if column_map else F.col(f"_a_{f}") for f in FIELDS}
    bare = {"documento": F.when(F.col("_virada"), 0).otherwise(1), "nome": F.when(F.col("_virada"), 1).otherwise(0), "tipo": F.when(F.col("_colunas") >= 3, 2)}
    where = [F.when(F.col("sem_cabecalho"), bare[f]).otherwise(found[f]).cast("int").alias(f"_{f}") for f in FIELDS]
    return d.select("arquivo", "sem_cabecalho", "_colunas", *where, F.when(~F.col("sem_cabecalho"), error).alias("_erro"))


def registry_rows(cells: DataFrame, column_map: dict[str, str] | None = None, headerless: bool = True) -> DataFrame:
    """arquivo, linha, tipo, documento, nome, erro, nome_lido and documento_lido of registries' rows.

    linha counts a file's rows with cells, the header too; it equals the sheet's own number where no row is blank. Rows
    blank in the fields are left out. The type is told or follows from the document's length; an error leaves tipo,
    documento and nome null. A file without its columns gives one row with its erro and no linha.
    """
    cells = written(cells.select("arquivo", "linha", "celulas").where("celulas IS NOT NULL"), "cells")
    heads = registry_heads(cells, column_map, headerless)
    d = cells.withColumn("_n", F.row_number().over(Window.partitionBy("arquivo").orderBy("linha")).cast("long")).join(heads.where("_erro IS NULL"), "arquivo").where("sem_cabecalho OR linha > 1")
    text = lambda f: F.when(F.col(f"_{f}") < F.col("_colunas"), _at(f"_{f}")["texto"])
    d = d.select("arquivo", F.col("_n").alias("linha"), F.trim(F.coalesce(text("tipo"), F.lit(""))).alias("_dito"), text_cell(text("documento")).alias("documento_lido"), text_cell(text("nome")).alias("nome_lido"))
    d = written(d.where("_dito <> '' OR documento_lido <> '' OR nome_lido <> ''"), "registry")
    told = person_type(F.col("_dito"))
    d = d.withColumn("_d", prepared_document(F.col("documento_lido"), told))
    valid = _document_valid(F.col("_d.tipo"), F.col("_d.documento"))
    number = F.regexp_replace(F.col("_d.documento"), "[^0-9]", "")
    wrong = F.when(F.col("_d.tipo") == "PJ", "CNPJ inválido").when(F.length(number) != 11, "CPF inválido: deve conter 11 dígitos").otherwise("CPF inválido: sequência repetida")
    error = (
        F.when(F.col("documento_lido") == "", "Documento vazio").when(F.col("nome_lido") == "", "Nome vazio").when((F.col("_dito") != "") & told.isNull(), F.concat(F.lit("Tipo inválido: "), F.col("_dito")))
        .when(F.col("_d.erro").isNotNull(), F.col("_d.erro")).when(valid.isNull(), wrong)
    )
    d = d.withColumns({"erro": error, "_valid": valid})
    good = lambda c: F.when(F.col("erro").isNull(), c)
    rows = d.select("arquivo", "linha", good(F.col("_d.tipo")).alias("tipo"), good(F.col("_valid")).alias("documento"), good(normalize_name(F.col("nome_lido"))).alias("nome"), "erro", "nome_lido", "documento_lido")
    return rows.unionByName(_file_error(heads), allowMissingColumns=True)


def header_preview(cells: DataFrame, headerless: bool = True) -> DataFrame:
    """arquivo, titulos, sem_cabecalho and the titles suggested for documento, nome and tipo, for a person to map columns.

    A file without a header gets the titles nome, documento, tipo, coluna_4 and so on.
    """
    heads = registry_heads(cells, None, headerless)
    first = cells.where("linha = 1 AND celulas IS NOT NULL").select("arquivo", _texts("celulas").alias("_t"))
    d = heads.join(first, "arquivo", "left")
    made = F.transform(F.sequence(F.lit(0), F.greatest("_colunas", F.lit(1)) - 1), lambda i: F.coalesce(F.get(F.array(*[F.lit(x) for x in ("nome", "documento", "tipo")]), i), F.concat(F.lit("coluna_"), (i + 1).cast("string"))))
    titles = F.filter(F.coalesce("_t", F.array().cast("array<string>")), lambda t: t != "")
    suggested = [F.when(F.col("sem_cabecalho"), F.when(F.lit(f != "tipo") | (F.col("_colunas") >= 3), f)).otherwise(F.when(F.col(f"_{f}") >= 0, F.get("_t", F.col(f"_{f}")))).alias(f) for f in ("documento", "nome", "tipo")]
    return d.select("arquivo", F.when(F.col("sem_cabecalho"), F.slice(made, F.lit(1), F.col("_colunas"))).otherwise(titles).alias("titulos"), "sem_cabecalho", *suggested)
