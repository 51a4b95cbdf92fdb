"""SimHash near-duplicates through covering locality-sensitive hashing (operator 1).

A fingerprint's bits lie in BLOCKS blocks, and each mask leaves out as many blocks as the radius. Whatever r bits two
fingerprints differ in, they lie in at most r blocks, so some mask leaves the difference out and the two collide in its
table: no pair within the radius is missed. For radius 2 and 6 blocks there are 15 tables whose keys keep 42 or more
bits, so that of 2e10 fingerprints under a tenth share a bucket by chance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.shared import ship, staged

BITS, BLOCKS = 64, 6
#: Shingles whose bits are spread out at once.
SPREAD = 1 << 15


def covering_masks(radius: int, bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    """The masks of kept bits, as unsigned integers; every set of at most radius bits is outside one of them."""
    return [sum(1 << i for i in range(bits) if i * blocks // bits not in out) for out in combinations(range(blocks), radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text, signed."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    words = raw.split()  # bytes: splits at \x20 and \x09-\x0d only
    if not words:
        return 0
    hashed, digest = [], xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashed.append(digest(b" ".join(words), seed))
    counts, total = np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, len(words) - shingle + 1, SPREAD):
        part = words[at : at + SPREAD + shingle - 1]
        hashed = [digest(b" ".join(x), seed) for x in zip(*(part[k:] for k in range(shingle)))]
        counts += _bit_counts(hashed)
    if len(words) < shingle:
        counts += _bit_counts(hashed)
    return _signed(int(np.packbits((2 * counts > total).reshape(8, 8)[:, ::-1], axis=1).tobytes()[::-1].hex(), 16))


def _bit_counts(hashed: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    spread = np.unpackbits(np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return spread.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp (signed 64-bit fingerprint) of every text; null and wordless texts have fingerprint zero."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint(F.col(text)).alias("fp"))


def close_pairs(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links a, b (representatives) that connect every two distinct fingerprints within the radius.

    fps has fp and rep, one row for each distinct fingerprint. A pair within the radius shares a bucket of the table
    whose mask leaves its difference out. A bucket's members are verified without being paired: each gives itself and its
    changes in one left-out bit, and two members differ in at most two left-out bits exactly if these values meet, so all
    that meet in one value are linked to the least of them. That keeps every component and never makes all pairs.
    """
    if radius != 2:
        raise ValueError("the verification by one-bit changes is for radius 2")
    masks = covering_masks(radius)
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for k, m in enumerate(masks)])
    tables = fps.select("rep", "fp", F.explode(keys).alias("x")).select("rep", "fp", "x.t", "x.key")
    shared = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    members = tables.join(shared, ["t", "key"])
    changes = [F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)).cast("long") for b in range(BITS) if not m >> b & 1]) for m in masks]
    of_table = F.get(F.array(*changes), F.col("t"))
    balls = staged(members.select("rep", F.explode(F.transform(of_table, lambda x: F.col("fp").bitwiseXOR(x))).alias("v")).distinct(), "balls")
    hubs = balls.groupBy("v").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("v", "hub")
    return balls.join(hubs, "v").where("rep <> hub").selectExpr("rep a", "hub b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs.

    component_id is the smallest doc_id that links reach, the document itself included. Texts without words have
    fingerprint zero and link like any other. Equal fingerprints are one node, so thousands of copies cost one.
    Repeated rows are each returned. A null doc_id names no document: such a row gets the component of its fingerprint
    if a named document has the same one, else null, and links nothing. Extra columns are ignored.
    """
    fps = staged(fingerprints(docs, shingle, text, doc_id), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "distinct")
    components = connected_components(close_pairs(distinct, radius))
    of_fp = distinct.join(components, distinct.rep == components.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of_fp, "fp", "left").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits of a 64-bit integer."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one of smallest doc_id.

    Of repeated rows with that doc_id one stays. Of rows without a doc_id one for each fingerprint stays, and none if a
    named document has that fingerprint. Null texts count as texts without words; an empty table gives an empty result;
    extra columns of any name are carried along.
    """
    found = near_duplicates(docs, **options)
    keep = staged(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    # The kept ids grow with docs: they are joined by sorting at every size, never sent to all tasks.
    kept = docs.join(keep.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    repeated = keep.where("n > 1").select("doc_id")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)
    # A row without a doc_id goes if a named document has its fingerprint.
    unnamed = docs.where("doc_id is null")
    if unnamed.isEmpty():
        return kept
    text = options.get("text", "text")
    held = unnamed.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    held = staged(held.withColumn("n", F.monotonically_increasing_id()), "unnamed")
    own = fingerprints(held, options.get("shingle", 3), "text", "n").select(F.col("doc_id").alias("n"), hex_of(F.col("fp")).alias("fingerprint"))
    named = found.where("doc_id is not null").select("fingerprint").distinct()
    alone = own.join(named, "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min("n").alias("n"))
    return kept.unionByName(held.join(alone.select("n"), "n", "left_semi").select("row.*"))
