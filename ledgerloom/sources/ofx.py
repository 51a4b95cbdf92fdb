"""OFX statement files as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _tag(block: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?i)<{name}>([^<\r\n]*)", 1)), F.lit(""))


def parse(files: DataFrame, content: str = "value", path: str = "path") -> DataFrame:
    """One row for each transaction block of the files' texts: arquivo, posicao and the ledger fields.

    Blocks without an amount or a date are left out; an amount that is no number is an error. The sign gives the
    direction, the first eight digits the date, and NAME, else MEMO, the description.
    """
    blocks = files.select(F.col(path).alias("arquivo"), F.posexplode(F.split(F.col(content), r"(?i)<STMTTRN>")).alias("posicao", "bloco")).where("posicao > 0")
    amount = _tag(F.col("bloco"), "TRNAMT")
    d = blocks.withColumn("_amount", amount).withColumn("_date", F.nullif(F.regexp_extract(_tag(F.col("bloco"), "DTPOSTED"), "^[0-9]{8}", 0), F.lit("")))
    d = d.where("_amount IS NOT NULL AND _date IS NOT NULL").withColumn("_number", F.replace(F.col("_amount"), F.lit(","), F.lit(".")).cast("decimal(15,2)"))
    return d.select(
        "arquivo", "posicao", F.to_date("_date", "yyyyMMdd").alias("data_movimento"), F.abs("_number").cast("decimal(15,2)").alias("valor"),
        F.when(F.col("_number") < 0, "SAIDA").otherwise("ENTRADA").alias("direcao"), F.coalesce(_tag(F.col("bloco"), "NAME"), _tag(F.col("bloco"), "MEMO"), F.lit("")).alias("descricao_raw"), _tag(F.col("bloco"), "FITID").alias("nr_extrato_bancario"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The transactions of the OFX files under a path; each file is one row until its blocks are taken apart."""
    files = spark.read.option("pathGlobFilter", "*.{ofx,OFX}").text(path, wholetext=True)
    return parse(files.withColumn("path", F.input_file_name()))
