"""Importance resampling against a plain count over all features."""

import collections
import hashlib
import math
import re
import zlib

import pyarrow.parquet as pq

from ledgerloom.llm import importance, queries

from .conftest import SF, counted

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(SMALL))
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs, target):
    """doc_id, n_features, weight, score, rank by the rule; docs are (doc_id, text)."""
    found = [(i, *features(t)) for i, t in docs]
    have, want = collections.Counter(), collections.Counter()
    for _, _, f in found:
        have.update(f)
    for t in target:
        want.update(features(t)[1])
    s, t = sum(have.values()), sum(want.values())
    rows = []
    for i, words, f in found:
        gains = [math.floor(1000 * math.log((want[k] + 1) * (s + 10000) / ((have[k] + 1) * (t + 10000)))) for k in f]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((k for k, r in enumerate(rows) if r[1] >= 20), key=lambda k: (-rows[k][4], rows[k][0] is None, rows[k][0] or 0, rows[k][2], rows[k][3]))
    rank = {k: at + 1 for at, k in enumerate(order[: 25 * len(order) // 100])}
    return [(r[0], r[2], r[3], r[4], rank.get(k)) for k, r in enumerate(rows)]


def test_importance_equals_the_rule(spark, texts):
    target = pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()
    rows = queries.op11_importance(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert counted(rows) == counted(plain(texts, target))
    assert any(r.rank for r in rows)


def test_importance_of_odd_rows(spark, odd, odd_texts):
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "text string")
    rows = importance.resample(odd, target).collect()
    assert counted(rows) == counted(plain(odd_texts, ["the quick brown fox", None, ""]))


def test_many_equal_rows_get_different_ranks(spark):
    docs = spark.range(1000).selectExpr("CASE WHEN id < 400 THEN 7L ELSE id END doc_id", "repeat('one two ', 20) text").repartition(7)
    ranks = sorted(r["rank"] for r in importance.resample(docs, docs).collect() if r["rank"])
    assert ranks == list(range(1, 251))


def test_importance_of_empty_tables(spark, odd, none):
    target = spark.createDataFrame([], "text string")
    assert importance.resample(none, odd).count() == 0
    assert counted(importance.resample(odd, target).collect()) == counted(plain([(r.doc_id, r.text) for r in odd.collect()], []))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 3)
    monkeypatch.setattr(importance, "MEMO", 2)
    words = importance.words_of_text("A b é c 1 d, e f_g")
    got = [int(b) for part in importance.Features().of(words) for b in part]
    assert collections.Counter(got) == collections.Counter(features("A b é c 1 d, e f_g")[1])


def test_drawn_documents_keep_their_columns(spark, odd):
    docs = odd.withColumn("rank", odd.doc_id)
    drawn = importance.drawn_documents(docs, docs)
    assert drawn.columns == [*docs.columns, "importance_rank"]
    ranks = {r.doc_id: r["rank"] for r in importance.resample(docs, docs).collect() if r["rank"] and r.doc_id is not None}
    assert {r.doc_id for r in drawn.collect()} == set(ranks)
