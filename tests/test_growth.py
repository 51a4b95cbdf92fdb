"""Work of registered queries that must not be done several times, and keys that are frequent."""

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.operators import consolidate, ingest
from ledgerloom.plans.views import view

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_origins_are_written_and_read_once_for_all_attributes(spark):
    found = plan(__spark_entry__.queries()["event_origins"](spark, SMALL))
    assert found.count("from_json(") == 1 and found.count("transform(") < 10


def test_dedup_deals_its_rows_once(spark):
    parsed = spark.range(50).select("id", (F.col("id") % 5).alias("cnpj_prestador"), F.lit(2024).alias("exercicio"), F.lit("x").alias("descricao_raw"), (F.col("id") % 2).cast("string").alias("direcao"))
    hashed = parsed.withColumn("hash", ingest.row_hash(parsed.columns))
    live = hashed.where("id IN (3, 4)").select("hash", (F.col("id") == 4).alias("deletado"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ingest.new_rows(parsed, live)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted(r.id for r in found.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_pairs_of_a_line_are_counted_without_making_them(spark):
    r = random.Random(3)
    pick = lambda *x: r.choice(x)
    rows = [(i, pick(1, 2, 3, None), pick("PIX", "PIX", "COMPLETO", "COMPLETO", "OUTRO", "X", None), datetime.date(2025, 1, pick(1, 2, 3, 4, 5, 6)), pick(Decimal(1), Decimal(2), None), pick("C", "D"), pick(None, 1, 2)) for i in range(400)]
    lines = spark.createDataFrame(rows, "id long, arquivo_id long, papel string, data_movimento date, valor decimal(15,2), direcao string, conta_id long")
    pairs = consolidate.candidate_pairs(lines).select(F.explode(F.array("a_id", "b_id")).alias("id"))
    want = {r.id: r["count"] for r in pairs.groupBy("id").count().collect()}
    found = {r.id: r.n_pares for r in consolidate.partner_counts(lines).collect()}
    assert len(want) > 100 and {i: n for i, n in found.items() if n} == want and len(found) == sum(x[1] is not None for x in rows)


def test_a_line_is_dealt_once_to_its_day_and_once_to_those_ahead(spark):
    lines = view(spark, SMALL, "linha")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = consolidate.candidate_pairs(lines.localCheckpoint())
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_singles_score_pairs_once_and_keep_no_weak_ones(spark, monkeypatch):
    lines, people = view(spark, SMALL, "linha"), view(spark, SMALL, "pessoa")
    lines = consolidate.linked(lines, people).cache()
    scored = consolidate.score_pairs(consolidate.candidate_pairs(lines)).cache()
    want = consolidate.singles(lines, consolidate.assign(consolidate.main_pairs(scored)), scored).collect()
    calls, score = [], consolidate.score_pairs
    monkeypatch.setattr(consolidate, "score_pairs", lambda pairs: calls.append(1) or score(pairs))
    monkeypatch.setattr(consolidate, "weak_pairs", lambda scored: 1 / 0)
    found = __spark_entry__.queries()["singles"](spark, SMALL).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(calls) == 1 and any(x.n_hipoteses for x in found)
