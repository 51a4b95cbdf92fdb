"""Person registries in CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.documents import normalize_cnpj, normalize_cpf, normalize_name
from ledgerloom.sources import sheets


def validated(rows: DataFrame) -> DataFrame:
    """linha, tipo, documento, nome and erro of raw rows (linha, documento, nome); the type follows from the document's length."""
    raw = F.upper(F.regexp_replace(F.coalesce("documento", F.lit("")), "[^A-Za-z0-9]", ""))
    n = F.length(raw)
    tipo = F.when((n > 0) & (n <= 11), "PF").when((n >= 12) & (n <= 14), "PJ")
    documento = F.when(tipo == "PF", normalize_cpf(F.lpad(raw, 11, "0"), strict=False)).when(tipo == "PJ", normalize_cnpj(F.lpad(raw, 14, "0")))
    name = normalize_name(F.coalesce("nome", F.lit("")))
    error = F.when(documento.isNull(), "documento inválido").when(name == "", "nome vazio")
    return rows.select("linha", tipo.alias("tipo"), documento.alias("documento"), name.alias("nome"), error.alias("erro"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the CSV files under a path, with headers found by aliases and each file's own separator (sheets.csv_cells).

    Lines are numbered in the file's order, the header being the first; blank ones are not counted.
    """
    cells = sheets.csv_cells(spark, path)
    heads = sheets.registry_heads(cells, headerless=False)
    lost = heads.where("_erro IS NOT NULL").first()
    if lost:
        raise ValueError(f"a registry needs documento and nome; {lost.arquivo}: {lost._erro}")
    rows = cells.where("linha > 1").join(heads, "arquivo")
    return validated(rows.select("linha", F.get("celulas", F.col("_documento"))["texto"].alias("documento"), F.get("celulas", F.col("_nome"))["texto"].alias("nome")))
