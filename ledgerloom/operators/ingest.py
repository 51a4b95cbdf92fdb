"""From parsed statement lines to ledger rows: keys, first-wins dedup, two-model consensus and balance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("cnpj_prestador", "exercicio", "data_movimento", "valor", "descricao_raw", "direcao", "cred_dev", "nr_extrato_bancario", "discriminador")
#: How far balances may differ from the lines between them.
BALANCE_TOLERANCE = 0.05


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the key's nine fields, joined by bars; fields that a table lacks are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("") for c in KEY]), 256)


def new_rows(parsed: DataFrame, live: DataFrame, order: str = "id") -> DataFrame:
    """The parsed rows that are to be inserted: the first of each key, unless a live row has it."""
    # What is live goes first: the rows are then dealt by hash, and the window needs no shuffle of its own.
    fresh = parsed.withColumn("hash", row_hash(parsed.columns)).join(live.where("NOT deletado").select("hash").distinct(), "hash", "left_anti")
    w = Window.partitionBy("cnpj_prestador", "exercicio", "hash").orderBy(order)
    return fresh.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def consensus(one: DataFrame, two: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Pairs the k-th row of a key in one reading with the k-th in the other: aceita where both have it, else incerta.

    The result has the keys, id_a and id_b.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    a = one.select(*keys, F.col(order).alias("id_a"), F.row_number().over(w).alias("k"))
    b = two.select(*keys, F.col(order).alias("id_b"), F.row_number().over(w).alias("k"))
    both = a.join(b, [*keys, "k"], "full")
    return both.select(*keys, "id_a", "id_b", F.when(F.col("id_a").isNotNull() & F.col("id_b").isNotNull(), "aceita").otherwise("incerta").alias("situacao"))


def balance_check(lines: DataFrame, balances: DataFrame, key: str) -> DataFrame:
    """For each key whether opening balance, lines and closing balance agree."""
    moved = lines.groupBy(key).agg(
        F.sum(F.when(F.col("direcao") == "ENTRADA", F.col("valor")).otherwise(0)).alias("creditos"),
        F.sum(F.when(F.col("direcao") == "SAIDA", F.col("valor")).otherwise(0)).alias("debitos"),
    )
    d = balances.join(moved, key, "left")
    credits, debits = F.coalesce("creditos", F.lit(0)), F.coalesce("debitos", F.lit(0))
    gap = F.col("saldo_inicial") + credits - debits - F.col("saldo_final")
    return d.select(key, credits.cast("decimal(18,2)").alias("creditos"), debits.cast("decimal(18,2)").alias("debitos"), (F.abs(gap) <= BALANCE_TOLERANCE).alias("consistente"))


def field_union(rows: DataFrame, fields: str, preferred: tuple[str, ...] = ()) -> DataFrame:
    """The keys that occur in a map column, preferred ones first, then by name, with their place."""
    found = rows.select(F.explode(F.map_keys(fields)).alias("campo")).distinct()
    rank = F.coalesce(*[F.when(F.col("campo") == p, F.lit(k)) for k, p in enumerate(preferred)], F.lit(len(preferred)))
    # One row for each field name of the statement layouts.
    return found.select("campo", F.row_number().over(Window.orderBy(rank, "campo")).alias("posicao"))


def merge_fields(a: Column, b: Column) -> Column:
    """Field map a, with those fields of b that it lacks and that aren't empty."""
    extra = F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k) & (F.coalesce(v, F.lit("")) != ""))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(a, extra))
