"""Byte-level BPE encoding and decoding (operator 9).

Distinct pieces of a batch lie in padded numpy matrices, bucketed by length. In each round every row merges its
leftmost pair of least rank, found through a hash table of pairs; merged rows close up and finished rows leave.
Pieces that come again are taken from a bounded memo.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ledgerloom.llm.pretokens import splitter
from ledgerloom.llm.shared import ship

NO_RANK = np.int32(2**31 - 1)
#: Rows times width of a matrix, at most.
CELLS = 1 << 21
#: Longer pieces are merged one by one with a heap, in n log n steps.
WIDEST = 128
#: Pieces that the memo of a Python worker holds, at most; then it starts again.
MEMO = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file whose lines hold a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Hash table from a pair of ids to the id of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(8, int(np.ceil(np.log2(4 * len(keys) + 1))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NO_RANK, np.int32)
        k, v = np.array(keys, np.int64), np.array(values, np.int32)
        slot, self.probes = self._slot(k), 0
        while len(k):  # place what finds a free slot first, then move on the rest
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.values[slot[put]] = k[put], v[put]
            rest = np.ones(len(k), bool)
            rest[put] = False
            k, v, slot = k[rest], v[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NO_RANK where there is none or where an id is negative."""
        shape = left.shape
        left, right = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        out = np.full(len(left), NO_RANK, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[at] << 32 | right[at]
        slot = self._slot(key)
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == key
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (held != -1)
            if not go.any():
                break
            at, key, slot = at[go], key[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class ByteBpe:
    """Encoder and decoder for a rank table; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = splitter(pattern)
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.memo: dict[str, bytes] = {}

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of about equal length."""
        n, width = len(pieces), max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[np.arange(width + 1) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(n), np.full((n, width), -1, np.int32)
        columns = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)  # the first of equal ranks: the leftmost
            here = np.arange(len(rows))
            least = ranks[here, at]
            done = least == NO_RANK
            if done.any():
                out[rows[done], : ids.shape[1] - 1] = ids[done, :-1]
                go = ~done
                rows, ids, ranks, at, least = rows[go], ids[go], ranks[go], at[go], least[go]
                lengths_now = (ids >= 0).sum(axis=1)
                width_now = int(lengths_now.max(initial=0))
                ids, ranks, columns = ids[:, : width_now + 1], ranks[:, :width_now], columns[:width_now]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            ids[here, at] = least
            move = columns[None, :] > at[:, None]
            ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])  # closes the gap right of the merged pair
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(move[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            ranks[here, at] = self.pairs.find(ids[here, at], ids[here, at + 1])
            left = at > 0
            ranks[here[left], at[left] - 1] = self.pairs.find(ids[here[left], at[left] - 1], ids[here[left], at[left]])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: a heap of pairs over a linked list."""
        ids = [int(x) for x in self.of_byte[np.frombuffer(piece, np.uint8)]]
        n, spans = len(ids), [piece[i : i + 1] for i in range(len(ids))]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := self.ranks.get(spans[i] + spans[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if spans[i] else n
            if j >= n or len(spans[i]) != a or len(spans[j]) != b:
                continue  # one of the two has changed since
            spans[i], ids[i] = spans[i] + spans[j], rank
            spans[j] = b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := self.ranks.get(spans[left] + spans[after[left]])) is not None:
                    heapq.heappush(heap, (r, left, len(spans[left]), len(spans[after[left]])))
        return np.array([x for x, s in zip(ids, spans) if s], np.int32)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit integers."""
        raw = [p.encode("utf-8") for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(raw):
            if len(p) > WIDEST:
                out[i] = self._long(p).astype("<u4").tobytes()
            elif p:
                buckets.setdefault((len(p) + 1) // 2 if len(p) <= 16 else 8 + (len(p) + 15) // 16, []).append(i)
        for members in buckets.values():
            width = max(len(raw[i]) for i in members)
            step = max(1, CELLS // (width + 1))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                ids = self._matrix([raw[i] for i in part])
                sizes = (ids >= 0).sum(axis=1).tolist()
                flat = ids[ids >= 0].astype("<u4").tobytes()
                start = 0
                for i, n in zip(part, sizes):
                    out[i] = flat[start : start + 4 * n]
                    start += 4 * n
        return out

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null has none."""
        split = [self.split(t or "") for t in texts]
        memo = self.memo
        new = list(set().union(*split).difference(memo))
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(set().union(*split))
        for at in range(0, len(new), 200_000):
            part = new[at : at + 200_000]
            memo.update(zip(part, self.encode_pieces(part)))
        for i, pieces in enumerate(split):
            split[i] = None
            yield np.frombuffer(b"".join(map(memo.__getitem__, pieces)), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder for each Python worker."""
    return ByteBpe(read_ranks(path), pattern)


def slices(texts: pa.Array, characters: int = 2_000_000) -> Iterator[list[str | None]]:
    """A batch's texts in lists of bounded size, so that few Python strings live at once."""
    part, size = [], 0
    for x in texts:
        t = x.as_py()
        part.append(t)
        size += len(t or "")
        if size >= characters:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds the column ids (array<int>) to docs; null texts get an empty array.

    A clashing column ids is replaced. Texts of any length, repeated rows and empty tables need no special care: rows
    are independent, and nothing is shuffled.
    """
    ship(docs.sparkSession)
    base = docs.drop("ids") if text != "ids" else docs

    def run(batches):
        bpe = loaded(ranks_path, pattern)
        for batch in batches:
            texts, start = batch.column(batch.schema.get_field_index("_text")), 0
            rest = batch.drop_columns(["_text"])
            for part in slices(texts):
                ids = [x.astype(np.int32) for x in bpe.encode_many(part)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                own = rest.slice(start, len(part))
                start += len(part)
                yield pa.RecordBatch.from_arrays([*own.columns, column], [*own.schema.names, "ids"])

    schema = StructType([*base.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    return base.withColumn("_text", F.col(text)).mapInArrow(run, schema)


def encode_checked(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (array<int>), and round_trip: whether the ids decode to the text's bytes.

    Encoding and decoding share one Python worker for each task, so that its memory holds one encoder.
    """
    ship(docs.sparkSession)

    def run(batches):
        bpe = loaded(ranks_path, pattern)
        for batch in batches:
            start = 0
            for part in slices(batch.column(3)):
                ids = [x.astype(np.int32) for x in bpe.encode_many(part)]
                same = [bpe.decode(x.tolist()) == (t or "").encode("utf-8") for t, x in zip(part, ids)]
                sizes = [len(x) for x in ids]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                own = batch.slice(start, len(part))
                start += len(part)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(sizes, pa.int32()), column, pa.array(same, pa.bool_())], ["doc_id", "source", "lang", "n_tokens", "ids", "round_trip"])

    schema = "doc_id long, source string, lang string, n_tokens int, ids array<int>, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text").mapInArrow(run, schema)


def encode_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, with decoding from the ids.

    Null texts count as empty: no tokens, and the digests of no bytes. Null doc_ids and repeated rows are returned as
    they are, one row each.
    """
    ship(docs.sparkSession)

    def run(batches):
        bpe = loaded(ranks_path, pattern)
        names = [str(i) for i in range(len(bpe.tokens))]
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for part in slices(batch.column(1)):
                for ids in bpe.encode_many(part):
                    listed = ids.tolist()
                    counts.append(len(listed))
                    encoded.append(hashlib.sha256(" ".join(map(names.__getitem__, listed)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(listed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)
