"""Token counts by separator scan (operator 8).

A flat token file is nothing but ids, two bytes each with the high byte first, and an end-of-document id after every
document; there is no index. Files are read in blocks; numpy finds the end ids of a block, and a prefix scan over the
blocks' summaries gives every block the number of documents before it and the place of the last end, which stitches
documents that cross block borders.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import read_ranks, slices
from ledgerloom.llm.shared import ship, staged

#: An id that no token has; its low byte is an ASCII character, which the writer puts at each line's end.
END_ID = 50256
#: Ids of a block.
BLOCK = 1 << 20
#: Bytes after which a file ends with the document at hand, so that a file is never longer than this and one document.
FILE_BYTES = 32 << 20


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def write_flat(docs: DataFrame, path: str, ranks_path: str, pattern: str, end_id: int = END_ID, text: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Writes docs as flat token files, in the order in which docs come. Null texts are empty documents.

    A file ends with the first document that brings it to file_bytes. An empty table gives files without a byte, or none.
    """
    ship(docs.sparkSession)
    if end_id & 0xFF >= 0x80 or end_id > 0xFFFF:
        raise ValueError("the end id's low byte must be an ASCII character, and it must have two bytes")

    def run(batches):
        encoding = _encoding(ranks_path, pattern)
        held = bytearray()

        def record():
            # The end id's last byte is the line separator that the writer adds.
            return pa.RecordBatch.from_arrays([pa.array([bytes(memoryview(held)[:-1])], pa.binary())], ["value"])

        for batch in batches:
            for part in slices(batch.column(0)):
                for t in part:
                    ids = encoding.encode_ordinary((t or "").encode("utf-8", "replace").decode("utf-8"))
                    if ids and max(ids) >= end_id:
                        raise ValueError("a token's id is not below the end id")
                    held += np.array([*ids, end_id], ">u2").tobytes()
                    if len(held) >= file_bytes:
                        yield record()
                        held = bytearray()
        if held:
            yield record()

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "value binary")
    writer = rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", chr(end_id & 0xFF))
    writer.option("maxRecordsPerFile", 1).text(path)  # a record is a file's documents


def count_tokens(spark: SparkSession, path: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """file (from 0, by name), doc_no (from 0, over all files), start and n_tokens of each document of flat files.

    n_tokens leaves the end id out; start counts all ids before the document, end ids too. Ids after a file's last end
    are a document of their own. A folder of empty files gives an empty result. A file is one row when it is read, so
    files must stay below 2 GB; write_flat() sees to that.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    # The blocks are cut before they become rows, so that no row carries a whole file.
    places = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / (2 * block)).cast("int"))
    cut = F.transform(places, lambda k: F.substring("content", k * F.lit(2 * block) + 1, F.lit(2 * block)))
    blocks = files.where("length > 0").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.posexplode(cut).alias("block", "raw"))

    def scan(batches):
        for batch in batches:
            counts, ends = [], []
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_py(), ">u2")
                counts.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
            lists = pa.array(ends, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), lists], ["name", "block", "n_ids", "ends"])

    found = staged(blocks.mapInArrow(scan, "name string, block int, n_ids long, ends array<int>"), "ends")
    sums = found.groupBy("name").agg(F.sum("n_ids").alias("ids"), F.sum(F.size("ends")).alias("docs"), F.max(F.when(F.size("ends") > 0, F.col("block") * F.lit(block) + F.array_max("ends"))).alias("last"))
    sums = sums.withColumn("open", F.col("ids") > F.coalesce(F.col("last") + 1, F.lit(0)))
    # One small row for each file.
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "name", "ids", "docs", "last", "open",
        (F.row_number().over(Window.orderBy("name")) - 1).alias("file"),
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_start"),
        F.coalesce(F.sum(F.col("docs") + F.col("open").cast("int")).over(before), F.lit(0)).alias("file_docs"),
    )
    # The prefix scan over a file's blocks.
    w = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(w), F.lit(0))
    scanned = found.select(
        "name", "ends", start.alias("block_start"),
        F.coalesce(F.sum(F.size("ends")).over(w), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max(F.when(F.size("ends") > 0, F.col("block") * F.lit(block).cast("long") + F.array_max("ends") + 1)).over(w), F.lit(0)).alias("carried"),
    )
    each = scanned.select("name", "block_start", "docs_before", "carried", "ends", F.posexplode("ends").alias("k", "end"))
    began = F.when(F.col("k") == 0, F.col("carried")).otherwise(F.col("block_start") + F.get("ends", F.col("k") - 1) + 1)
    closed = each.select("name", (F.col("docs_before") + F.col("k")).alias("k"), began.alias("s"), (F.col("block_start") + F.col("end") - began).alias("n"))
    rest = sums.where("open").select("name", F.col("docs").alias("k"), F.coalesce(F.col("last") + 1, F.lit(0)).cast("long").alias("s"), (F.col("ids") - F.coalesce(F.col("last") + 1, F.lit(0))).alias("n"))
    rows = closed.unionByName(rest).join(sums.select("name", "file", "file_start", "file_docs"), "name")
    return rows.select(F.col("file").cast("long").alias("file"), (F.col("file_docs") + F.col("k")).cast("long").alias("doc_no"), (F.col("file_start") + F.col("s")).cast("long").alias("start"), F.col("n").cast("long").alias("n_tokens"))
