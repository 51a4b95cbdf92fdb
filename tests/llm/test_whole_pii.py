"""Long secrets and written-out addresses are one span each."""

import time

from pyspark.sql import functions as F

from ledgerloom.llm.pii import KINDS, candidate_spans, redact


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = docs.select("k", candidate_spans(F.col("text")).alias("c")).orderBy("k").collect()
    return [[(KINDS[x.kind], x.start, x.stop, x.known) for x in r.c] for r in rows]


def test_a_long_run_is_one_span(spark):
    key, name = "aB3/" * 200, "n" * 100
    host = ".".join(["label" * 20] * 12)
    texts = [f"token={key} end", f'"api_key": "{key}"', f"{name} [at] {host} end", f"x {name}[at]example[dot]{'d' * 90}[dot]org end"]
    found = spans(spark, texts)
    assert [s[:3] for s in found[0]] == [("secret", 0, 806)]
    assert [s[2] for s in found[1] if s[0] == "secret"] == [len(texts[1])]
    assert [s[:3] for s in found[2] if s[0] == "email"] == [("email", 0, len(texts[2]) - 4)]
    assert [s[:3] for s in found[3] if s[0] == "email"] == [("email", 2, len(texts[3]) - 4)]


def test_redaction_leaves_no_tail(spark):
    rows = [(i, f"the secret: {'k3Y' * (5 + i)} was here") for i in range(400)]
    out = redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.text for r in out} == {"the <SECRET> was here"}


def test_long_runs_take_linear_time(spark):
    began = time.time()
    letters, digits = spans(spark, ["token=" + "x" * 2_000_000, "token=" + "7" * 2_000_000])
    assert letters == [("secret", 0, 2_000_006, 0)]
    assert [s[:3] for s in digits if s[0] == "secret"] == [("secret", 0, 2_000_006)]
    assert time.time() - began < 60
