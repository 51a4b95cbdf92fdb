"""XML documents against a schema, through Spark's own XML reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALID, INVALID, UNCHECKED = "valido", "invalido", "nao_validado"


def validated(documents: DataFrame, schemas: dict[str, str], kind: str = "documento", xml: str = "xml") -> DataFrame:
    """documents with validacao: valido, invalido, or nao_validado for a kind without a schema.

    schemas maps a kind to the path of its XSD, which every worker must reach (SparkContext.addFile ships it under its
    name). Each row is one fragment. The reader checks a row against the schema and hands what fails back as a corrupt
    record; a null fragment is invalid where there is a schema.
    """
    verdict = F.lit(UNCHECKED)
    for name, path in schemas.items():
        read = F.from_xml(F.coalesce(F.col(xml), F.lit("")), "_ok string, _corrupt string", {"rowValidationXSDPath": path, "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
        verdict = F.when(F.col(kind) == name, F.when(read["_corrupt"].isNull() & F.col(xml).isNotNull(), VALID).otherwise(INVALID)).otherwise(verdict)
    return documents.withColumn("validacao", verdict)


def verdicts(documents: DataFrame, schemas: dict[str, str], kind: str = "documento") -> DataFrame:
    """How many fragments of each kind are valid, invalid or not checked, and whether the kind may be exported: nothing invalid."""
    d = validated(documents, schemas, kind)
    counts = d.groupBy(kind).agg(*[F.count_if(F.col("validacao") == v).alias(v) for v in (VALID, INVALID, UNCHECKED)])
    return counts.withColumn("exportavel", F.col(INVALID) == 0)
