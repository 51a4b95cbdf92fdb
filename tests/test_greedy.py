"""The greedy from lines against pairs taken one by one, and what it writes."""

import datetime
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.functions import documents as D
from ledgerloom.operators import consolidate, greedy
from ledgerloom.plans import registered
from ledgerloom.plans.views import TABLES

from .test_ledger import SF, brute_greedy, plain

NAMES = (None, None, "", "ANA", "ANA LIMA", "A LIMA", "ANA M LIMA", "MARIANA LIMA", "LIMA ANA", "JOSE", "JOSE SOUZA", "SOUZA JOSE", "J S SOUZA", "J S", "JO SOUZA")


def odd_lines(spark, seed, n=600):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    rows = [
        (
            i, pick(1, 2, 3, None), pick("PIX", "PIX", "COMPLETO", "COMPLETO", "OUTRO", "X", None), datetime.date(2025, 1, 1) + datetime.timedelta(pick(0, 1, 1, 2, 3, 4, 5, 9, 10, 40)), pick(Decimal(1), Decimal(2), None), pick("C", "C", "D", None),
            pick(None, None, None, None, None, "1", "2", "3"), pick(None, None, None, "7", "8"), pick(*NAMES), pick(None, "10:00", "10:04", "11:03"), pick(None, "021002", "021002", "031003", "051000"), pick(None, 1, 2),
        )
        for i in r.sample(range(10 * n), n)
    ]
    lines = spark.createDataFrame(rows, "id long, arquivo_id long, papel string, data_movimento date, valor decimal(15,2), direcao string, cpf string, cnpj string, nome string, hora string, nr_documento string, conta_id long")
    people = [(1, "PF", "1", "ANA LIMA"), (2, "PF", "2", "CARLA"), (7, "PJ", "7", "JOSE SOUZA"), (9, "PJ", "9", "MARIANA LIMA")]
    return consolidate.linked(lines, spark.createDataFrame(people, "pessoa_id long, tipo string, documento string, nome string"))


@pytest.mark.parametrize("seed, small", [(1, False), (2, True)])
def test_greedy_of_lines_equals_one_by_one(spark, monkeypatch, seed, small):
    if small:  # days are cut into blocks, and their pairs made again for each confidence
        monkeypatch.setattr(greedy, "BLOCK", 64)
        monkeypatch.setattr(greedy, "HELD", 2)
    lines = odd_lines(spark, seed).cache()
    pairs = consolidate.main_pairs(consolidate.score_pairs(consolidate.candidate_pairs(lines))).collect()
    found = greedy.assign_lines(lines).select("a_id", "b_id", "confianca").collect()
    assert {p.confianca for p in pairs} == set(greedy.LEVELS)
    assert plain(found) == plain(brute_greedy(pairs)) and len(found) > 30
    assert greedy.assign_lines(lines.limit(0)).count() == 0


def test_names_agree_as_in_spark(spark):
    names = [n for n in NAMES if n] + ["A B C D", "ANA ANA", "ANA", "ÇA IRA", "IRA", "A ANA", "ANA A", "LIM"]
    d = spark.createDataFrame([(n,) for n in names], "x string")
    agreed = d.crossJoin(d.withColumnRenamed("x", "y")).select("x", "y", D.names_agree(F.col("x"), F.col("y")).alias("z")).collect()
    assert [r for r in agreed if r.z != greedy.names_agree(r.x, r.y)] == [] and 0 < sum(r.z for r in agreed) < len(agreed)


def test_greedy_and_singles_write_no_pairs(spark, monkeypatch, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        copied = "" if t != "lineitem" else "REPLACE (i * 9 AS l_orderkey, i * 5 AS l_suppkey, 1 AS l_quantity, 'A' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1996-01-02' AS l_shipdate, 3 AS l_partkey)"
        con.execute(f"COPY (SELECT * {copied} FROM (SELECT *, row_number() OVER () AS i FROM '{SF}/{t}.parquet' LIMIT 120)) TO '{tmp_path}/{t}.parquet'")
    sizes, write = [], consolidate.written

    def spied(df, name):
        out = write(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(consolidate, "written", spied)
    monkeypatch.setattr(registered, "written", spied)
    taken = __spark_entry__.queries()["pair_greedy"](spark, str(tmp_path)).collect()
    alone = __spark_entry__.queries()["singles"](spark, str(tmp_path)).collect()
    assert len(taken) > 30 and len(alone) == 120 - 2 * len(taken)
    assert max(sizes) == 120  # the lines; pairs of one document, day and amount are in the thousands
