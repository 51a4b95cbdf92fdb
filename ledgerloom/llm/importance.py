"""Importance resampling toward a target distribution, by hashed word runs (operator 11).

Two passes in Arrow batches. The first turns every batch into a vector of BUCKETS counts (np.bincount) and every partition
into one such vector; treeReduce adds the vectors up, so that the driver gets one, whatever the number of partitions. The
second broadcasts the gains (one long for each bucket: a fixed size) and sums them for each document (np.bincount with
weights). Ranks come from a range sort of narrow rows and a prefix sum over partitions; no window holds a hot group.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import ship, staged

BUCKETS, RUN, SHARE, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Bytes that separate words, made spaces, and A-Z, made small; bytes from 0x80 on belong to words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Features of one text that are held at once.
CHUNK = 1 << 16
#: Entries of the memo of words' checksums in a task.
MEMO = 1 << 18


def words_of_text(text: str | None) -> list[bytes]:
    """The words of a text in lower case (A-Z only), as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class _Checksums(dict):
    """crc32 of a word, or of a word and the space after it; forgets all when it is full."""

    def __init__(self, tail: bytes):
        super().__init__()
        self.tail = tail

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = zlib.crc32(word + self.tail)
        return found


class Features:
    """Gives texts' feature buckets in bounded pieces."""

    def __init__(self, run: int = RUN, buckets: int = BUCKETS):
        self.run, self.buckets = run, buckets
        self.last, self.before = _Checksums(b""), _Checksums(b" ")

    def of(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Buckets of all runs of 1 to run consecutive words."""
        crc = zlib.crc32
        for start in range(0, len(words), CHUNK):
            stop = min(len(words), start + CHUNK)
            yield np.fromiter(map(self.last.__getitem__, words[start:stop]), np.int64, stop - start) % self.buckets
            # The checksum of a longer run goes on from that of the run without its last word and with a space.
            heads = list(map(self.before.__getitem__, words[start:stop]))
            for n in range(1, self.run):
                ends = words[start + n : stop + n]
                yield np.fromiter(map(crc, ends, heads), np.int64, len(ends)) % self.buckets
                if n + 1 < self.run:
                    heads = [crc(b" ", crc(w, h)) for w, h in zip(ends, heads)]


def bucket_counts(texts: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Null and wordless texts have none; no rows give zeros."""
    ship(texts.sparkSession)

    def count(batches):
        features, total = Features(run, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                for found in features.of(words_of_text(t.as_py())):
                    total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    vectors = texts.select(F.col(f"`{text}`").alias("t")).mapInArrow(count, "v binary").rdd.map(lambda r: np.frombuffer(r.v, np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add, depth=3)


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket, in doubles."""
    s, t, n = int(have.sum()), int(want.sum()), len(have)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(have.tolist(), want.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))) with h of sha256 of seed:doc_id; a null doc_id leaves nothing after the colon."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    shared, buckets = spark.sparkContext.broadcast(gain.astype(np.float64)), len(gain)

    def score(batches):
        features, of_bucket = Features(run, buckets), shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n_words = np.zeros(len(ids), np.int64)
            n, total, waiting, held = np.zeros(len(ids), np.int64), np.zeros(len(ids)), [], 0

            def settle():
                nonlocal total, n, waiting, held
                if waiting:
                    rows = np.repeat([k for k, _ in waiting], [len(f) for _, f in waiting])
                    total += np.bincount(rows, weights=of_bucket[np.concatenate([f for _, f in waiting])], minlength=len(ids))
                    n += np.bincount(rows, minlength=len(ids))
                waiting, held = [], 0

            for k, t in enumerate(batch.column(1)):
                words = words_of_text(t.as_py())
                n_words[k] = len(words)
                for found in features.of(words):
                    waiting.append((k, found))
                    held += len(found)
                    if held > 8 * CHUNK:
                        settle()
            settle()
            weight = total.astype(np.int64) // np.maximum(n, 1)  # sums are whole numbers far below 2^53
            drawn = weight + np.fromiter((gumbel(i, seed) for i in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n), pa.array(weight), pa.array(drawn)], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, eligible: str, order: list, at: str = "rank") -> DataFrame:
    """rows with their place (from 1) among those that are eligible, by order; null for the others.

    The rows are sorted by range and each partition's start is the sum of the counts before it. A whole order makes even
    a group of equal rows divisible, so the last sort key is a random one.
    """
    among = rows.where(eligible).withColumn("_any", F.rand(17))
    among = among.repartitionByRange(*order, F.col("_any")).sortWithinPartitions(*order, F.col("_any")).drop("_any")
    among = staged(among.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    counts = among.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.selectExpr("_part", "sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before")  # a row for each partition
    placed = among.join(F.broadcast(before), "_part").withColumn(at, F.expr("coalesce(_before, 0L) + (_at & 8589934591L) + 1L")).select(*rows.columns, at)
    return placed.unionByName(rows.where(f"NOT coalesce({eligible}, false)").withColumn(at, F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row for each row of docs; rank is null unless the row is drawn.

    weight is the floored mean of the gains over a document's features (none: 0); score adds Gumbel noise that depends
    on seed and doc_id alone, so reruns agree. Of the N rows with at least `least` words the floor(share * N / 100) of
    highest score are drawn; ties go to the smaller doc_id (null last), then to fewer features and smaller weight.
    Null texts count as empty. Repeated rows count and compete each. A null doc_id has one noise for all such rows. An
    empty docs gives an empty result; an empty target gives every bucket t = 0. Extra columns are ignored. A text's
    features are held in pieces of CHUNK; only its words are held whole.
    """
    gain = gains(bucket_counts(docs, text, run, buckets), bucket_counts(target, target_text, run, buckets))
    rows = staged(weigh(docs, gain, doc_id, text, run, seed), "weighed")
    draw = rows.agg(F.count(F.when(F.col("n_words") >= least, 1))).first()[0] * share // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = ranked(rows, f"n_words >= {least}", order)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns and their rank as importance_rank.

    Rows share a rank's document by doc_id: a doc_id that occurs on several rows is drawn with all of them, once each,
    under the best of their ranks. Rows without a doc_id can't be told apart and are left out.
    """
    found = resample(docs, target, doc_id=doc_id, **options).where("rank is not null and doc_id is not null")
    best = found.groupBy(F.col("doc_id").alias("_drawn")).agg(F.min("rank").alias("importance_rank"))
    held = docs.drop("importance_rank") if "importance_rank" in docs.columns else docs
    return held.join(best, held[doc_id].cast("long") == best["_drawn"]).drop("_drawn")
