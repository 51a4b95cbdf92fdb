"""Extraction as an incremental job: only contents that no earlier run has seen are processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.storage import written

CACHE = "chave string, modelo string, resposta string"


def content_key(content: str = "conteudo", model: str = "modelo"):
    """The key of a content under a model: SHA-256 of both, told apart by the content's length."""
    raw = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return F.sha2(F.concat(F.concat_ws(":", F.col(model), F.octet_length(raw).cast("string"), F.lit("")).cast("binary"), raw), 256)


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache's answers; an empty table where there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def extracted(files: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """files with chave and resposta, and how many contents were new.

    files has conteudo and modelo. extract gets the distinct contents that the cache under path lacks (chave, modelo,
    conteudo) and gives chave and resposta; its answers are appended to the cache in one commit. A content that occurs on
    several files is processed once, one without an answer is asked again in the next run. A run over files that were all
    seen appends nothing and never calls for a content. Only keys are compared; contents are not shuffled but for new ones.
    """
    spark = files.sparkSession
    keyed = files.withColumn("chave", content_key())
    seen = cached(spark, path).select("chave").distinct()
    unseen = written(keyed.select("chave", "modelo", "conteudo").join(seen, "chave", "left_anti").dropDuplicates(["chave"]), "unseen")
    n = unseen.count()
    if n:
        answers = extract(unseen).where("resposta IS NOT NULL").join(unseen.select("chave", "modelo"), "chave")
        answers.select("chave", "modelo", "resposta").write.mode("append").parquet(path)
    known = cached(spark, path).groupBy("chave").agg(F.min("resposta").alias("resposta"))
    return keyed.join(known, "chave", "left"), n
