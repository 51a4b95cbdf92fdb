"""Token ids in a content-addressed store (operator 4).

A rolling hash over the last few ids cuts every document's id stream into chunks wherever the hash has a given form, so
equal passages give equal chunks whatever stands before them. Chunks are named by the SHA-256 of their ids and stored
once. A document's recipe lists its chunks; the root of a Merkle tree over their names says what the whole must be. A
further Merkle tree stands over the documents: each one's leaf covers its id, place, counts and root, a node covers FAN
leaves, a part's root covers its nodes, and the store's root, in the manifest, covers the parts.

Folder of a store:
    data/kind=chunk/   Parquet: hash (32 bytes), ids (little-endian, 2 or 4 bytes each)
    recipes/           Parquet in ascending doc_id order, file by file: doc_id, part, place, local_start, n_tokens, hashes, counts, root
    manifest/          Parquet: part, n_documents, n_tokens, root; ids of all earlier parts (part_start); store_root
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.pretokens import byte_level_cuts
from ledgerloom.llm.shared import delete_path, ship

#: Ids that the rolling hash sees, and the bounds and mean of a chunk's length in ids.
REACH, LEAST, MEAN, MOST = 8, 128, 512, 4096
#: Ids that are hashed at once.
BLOCK = 1 << 15
#: Names of chunks that a task has already sent on, at most; more may be sent again and are dropped after the shuffle.
SENT = 200_000
#: Pieces and their characters that a worker's memo holds, at most; then it starts again.
MEMO, MEMO_CHARACTERS = 800_000, 50_000_000
#: Bytes of texts that are encoded at once; a longer text is encoded alone.
SLICE = 4_000_000
#: New pieces that the library gets as lines of one text.
LINED = 512
#: A piece that is one in any text of lines: letters and digits or printable ASCII, but for one space before them.
PLAIN = re.compile(r" ?(?:[^\W_]+|[!-~]+)").fullmatch
#: Documents below one node of the manifest's tree.
FAN = 1024


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of texts without nulls, and their bytes."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return bounds - bounds[0], np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch's texts in arrays of bounded size, so that the columns made of them stay small."""
    sizes, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
        yield texts.slice(start, end - start)
        start = end


class PieceTokenizer:
    """The tokenizers library over pieces, with a bounded memo of those already seen.

    The pieces of many texts are cut and numbered as columns; Python sees the distinct ones only. The memo gives each
    piece a number, under which its ids lie in one array. Texts with one of the file's added tokens go to the library
    whole: those are found before any cut into pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.characters = 0
        self.ids, self.starts, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, and where those of each begin and how many they are."""
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate(found), np.cumsum(sizes) - sizes, sizes

    def _lined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for plain pieces, as the lines of one text, whose line ends are pieces of their own: a call costs more than a piece does."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(pieces) - 1:
            return self._each(pieces)
        starts = np.concatenate([[0], ends + 1])
        return ids, starts, np.append(ends, len(ids)) - starts

    def _learn(self, pieces: list[str]) -> None:
        plain = list(map(PLAIN, pieces)) if self.line_end is not None else [None] * len(pieces)
        lined, others = list(compress(pieces, plain)), list(compress(pieces, map(not_, plain)))
        blocks = [(self._lined, lined[at : at + LINED]) for at in range(0, len(lined), LINED)]
        blocks += [(self._each, others[at : at + 4096]) for at in range(0, len(others), 4096)]
        ids, starts, sizes, held = [self.ids], [self.starts], [self.sizes], len(self.ids)
        for encode, block in blocks:
            i, s, n = encode(block)
            self.memo.update(zip(block, range(len(self.memo), len(self.memo) + len(block))))
            self.characters += sum(map(len, block))
            ids.append(i)
            starts.append(s + held)
            sizes.append(n)
            held += len(i)
        self.ids, self.starts, self.sizes = map(np.concatenate, (ids, starts, sizes))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The memo's numbers of distinct pieces; new ones are learnt."""
        found = np.fromiter(map(self.memo.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        if len(self.memo) + len(new) > MEMO or self.characters > MEMO_CHARACTERS:
            self._forget()
            new = np.arange(len(pieces))
        if len(new):
            unknown = [pieces[i] for i in new.tolist()]
            self._learn(unknown)
            found[new] = np.fromiter(map(self.memo.__getitem__, unknown), np.int64, len(unknown))
        return found

    def _texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls and added tokens, in a row, and the bounds of each one's."""
        bounds, data = _bytes_of(texts)
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(len(bounds), np.int64)
        cut = byte_level_cuts(data, bounds[:-1][bounds[1:] > bounds[:-1]])
        offsets = pa.py_buffer(np.append(cut, len(data)).astype(np.int32))
        pieces = pa.StringArray.from_buffers(len(cut), offsets, pa.py_buffer(data)).dictionary_encode()
        number = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        sizes = self.sizes[number]
        till = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[number] - till + sizes, sizes) + np.arange(till[-1])]
        return ids, np.append(0, till)[np.searchsorted(cut, bounds)]

    def encode_joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each one's; null has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        marked = np.zeros(len(texts), bool)
        for a in self.added:
            marked |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._texts(texts)
        ids, bounds = self._texts(pc.if_else(pa.array(marked), "", texts))
        parts = [ids[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in np.flatnonzero(marked).tolist():
            parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null has none."""
        ids, bounds = self.encode_joined(pa.array(texts, pa.string()))
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[x:y]


@lru_cache(maxsize=2)
def loaded(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value of each id."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the ids at which the rolling hash has the form of a cut."""
    found = [np.empty(0, np.int64)]
    for at in range(0, len(ids), BLOCK):
        before = min(at, REACH - 1)
        g = _mixed(ids[at - before : at + BLOCK])
        h = g.copy()
        for k in range(1, min(REACH, len(g))):
            h[k:] += g[:-k] << np.uint64(8 * k)
        found.append(np.flatnonzero((h[before:] >> np.uint64(40)).astype(np.uint32) % np.uint32(MEAN - LEAST) == 0) + (at + 1))
    return np.concatenate(found)


def _ends(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of n ids with these marks."""
    if n <= LEAST:
        return [n] if n else []
    ends, last = [], 0
    for end in marks:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST:
            ends.append(end)
            last = end
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends + [n] if last < n else ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return _ends(len(ids), _marks(ids).tolist())


def cuts_of(ids: np.ndarray, bounds: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of many id streams that stand in a row, each as if it stood alone: no chunk ends where the hash still sees the stream before."""
    marks = _marks(ids)
    at = np.searchsorted(marks, bounds, "right").tolist()
    for k, (start, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        yield _ends(end - start, (marks[at[k] : at[k + 1]] - start).tolist())


def merkle_root(names: list[bytes]) -> bytes:
    """The root over names: pairs are hashed level by level, an odd last one goes up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in names]
    if not level:
        return hashlib.sha256(b"").digest()
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encoder(path: str, end_id: int, width: int):
    names = ["kind", "hash", "ids", "doc_id", "n_tokens", "hashes", "counts", "root"]
    types = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]

    def run(batches):
        tokenizer, sent = loaded(path), set()
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                chunks, recipes = [], []
                ids, bounds = tokenizer.encode_joined(part)
                ids, bounds = np.insert(ids, bounds[1:], end_id).astype(f"<u{width}"), bounds + np.arange(len(bounds))
                stored = ids.tobytes()
                for doc_id, first, ends in zip(batch.column(0)[at : at + len(part)].to_pylist(), bounds.tolist(), cuts_of(ids, bounds)):
                    start, hashes, counts = 0, [], []
                    for stop in ends:
                        raw = stored[width * (first + start) : width * (first + stop)]
                        name = hashlib.sha256(raw).digest()
                        if name not in sent:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(name)
                            chunks.append((name, raw))
                        hashes.append(name)
                        counts.append(stop - start)
                        start = stop
                    recipes.append((doc_id, start, hashes, counts, merkle_root(hashes)))
                at += len(part)
                c, r = len(chunks), len(recipes)
                columns = [["chunk"] * c + ["recipe"] * r, [x[0] for x in chunks] + [None] * r, [x[1] for x in chunks] + [None] * r]
                columns += [[None] * c + [x[k] for x in recipes] for k in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names)

    return run


def _over(order: str, node: str):
    """The node above others, which stand in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, node))), lambda x: x[node]), ""), 256)


def part_roots(recipes: DataFrame) -> DataFrame:
    """part, n_documents, n_tokens and the root of the Merkle tree over each part's documents; no group is above FAN leaves or a part's nodes."""
    said = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "local_start", "n_tokens", F.array_join(F.col("counts").cast("array<string>"), ","), F.hex("root")]
    leaves = recipes.select("part", "place", F.floor(F.col("place") / FAN).alias("node"), "n_tokens", F.sha2(F.concat_ws(":", *said), 256).alias("leaf"))
    nodes = leaves.groupBy("part", "node").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), _over("place", "leaf").alias("hash"))
    return nodes.groupBy("part").agg(F.sum("n").alias("n_documents"), F.sum("t").alias("n_tokens"), _over("node", "hash").alias("root"))


RECIPE = "doc_id long, part int, place long, local_start long, n_tokens long, hashes array<binary>, counts array<int>, root binary"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, width: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encodes docs and writes a store under path.

    width is the bytes of an id: 2 if the vocabulary has at most 65,536 ids. Null texts count as empty: the end id only.
    Documents stand in ascending doc_id order, null first; repeated rows are kept, each with a recipe. An empty table
    gives an empty store. Tasks that run again write the same bytes, and only committed files count.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "kind string, hash binary, ids binary, doc_id long, n_tokens long, hashes array<binary>, counts array<int>, root binary"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encoder(tokenizer_path, end_id, width), schema)
    # Each task has sent a chunk once already; here the copies of different tasks meet.
    w = Window.partitionBy("kind", "hash", "doc_id").orderBy("n_tokens")
    unique = rows.withColumn("_k", F.row_number().over(w)).where("kind = 'recipe' or _k = 1").drop("_k")
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")
    recipes = spark.read.schema(schema).parquet(f"{path}/data").where("kind = 'recipe'").select("doc_id", "n_tokens", "hashes", "counts", "root")
    ordered = recipes.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")

    def place(batches):
        part, start, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n) + start
            columns = [batch.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(np.arange(place, place + len(n)), pa.int64()), pa.array(ends - n, pa.int64()), *batch.columns[1:]]
            place += len(n)
            start = int(ends[-1]) if len(n) else start
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "place", "local_start", *batch.schema.names[1:]])

    ordered.mapInArrow(place, RECIPE).write.option("compression", "zstd").parquet(f"{path}/recipes")

    written = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    delete_path(spark, f"{path}/data/kind=recipe")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    started = part_roots(written).withColumn("part_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    started.withColumn("store_root", F.sha2(F.array_join(F.collect_list("root").over(every), ""), 256)).coalesce(1).write.parquet(f"{path}/manifest")


def _powers() -> list[int]:
    """x^(2^k) modulo the CRC polynomial, reflected."""
    p = [1 << 30]
    for _ in range(31):
        p.append(_times(p[-1], p[-1]))
    return p


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC polynomial, reflected."""
    out, bit = 0, 1 << 31
    while a:
        if a & bit:
            out ^= b
            a ^= bit
        bit >>= 1
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1
    return out


POWERS = _powers()


@lru_cache(maxsize=1 << 16)
def _shift(n_bytes: int) -> int:
    """The factor that stands for n_bytes more bytes."""
    out, k = 1 << 31, 3
    while n_bytes:
        if n_bytes & 1:
            out = _times(POWERS[k & 31], out)
        n_bytes >>= 1
        k += 1
    return out


def crc32_joined(pieces: list[tuple[int, int]]) -> int:
    """CRC-32 of pieces in a row, from each one's (crc32, length in bytes)."""
    crc = 0
    for piece, n in pieces:
        crc = _times(_shift(n), crc) ^ piece if crc else piece
    return crc


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with start, after a check of each part against the manifest."""
    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")
    found = part_roots(recipes).select("part", F.col("n_documents").alias("n"), F.col("n_tokens").alias("t"), F.col("root").alias("found"))
    same = F.coalesce((F.col("n") == F.col("n_documents")) & (F.col("t") == F.col("n_tokens")) & (F.col("found") == F.col("root")), F.lit(False))
    checked = found.join(manifest, "part", "full").withColumn("_ok", F.when(same, True).otherwise(F.raise_error(F.lit("a part differs from its manifest")).cast("boolean")))
    checked = checked.where("_ok").select("part", "part_start")
    return recipes.join(checked, "part").withColumn("start", F.col("part_start") + F.col("local_start"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hash binary, ids binary, kind string").parquet(f"{path}/data").where("kind = 'chunk'").drop("kind")


def read_digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of a store.

    Every chunk is read once, checked against its name and reduced to the CRC-32 of its ids as 32-bit integers; a
    document's CRC-32 follows from those of its chunks in order, so no ids move. A chunk that is missing, changed or not as
    long as the recipe says, or a recipe that its root or its part's manifest doesn't bear out, is an error.
    """
    ship(spark)

    def reduce(batches):
        for batch in batches:
            names, crcs, lengths = batch.column(0).to_pylist(), [], []
            for name, raw in zip(names, batch.column(1)):
                raw = raw.as_py()
                if hashlib.sha256(raw).digest() != name:
                    raise ValueError("a chunk differs from its name")
                lengths.append(len(raw) // width)
                crcs.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(crcs, pa.int64()), pa.array(lengths, pa.int32())], ["hash", "crc", "n"])

    crcs = _chunks(spark, path).mapInArrow(reduce, "hash binary, crc long, n int")
    recipes = _recipes(spark, path).withColumn("_row", F.concat_ws(":", "part", "local_start"))
    lines = recipes.select("_row", F.posexplode("hashes").alias("at", "hash"))
    # The names that many recipes share are joined like any others; Spark splits their partition where it grows.
    joined = lines.join(crcs, "hash", "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "crc", "n"))).alias("_crcs"))
    whole = recipes.join(joined, "_row", "left")

    def fold(batches):
        for batch in batches:
            d = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = []
            for hashes, counts, root, crcs, n_tokens in zip(*(d[k].to_pylist() for k in ("hashes", "counts", "root", "_crcs", "n_tokens"))):
                got = [c["crc"] for c in crcs or []]
                if merkle_root(hashes) != root or len(got) != len(hashes) or [c["n"] for c in crcs or []] != counts or sum(counts) != n_tokens:
                    raise ValueError("a document cannot be rebuilt from its recipe")
                out.append(crc32_joined([(c, 4 * n) for c, n in zip(got, counts)]))
            yield pa.RecordBatch.from_arrays([d["doc_id"], d["start"], d["n_tokens"], pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    needed = whole.select("doc_id", "start", "n_tokens", "hashes", "counts", "root", "_crcs")
    return needed.mapInArrow(fold, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start and ids (array<int>) of every document, put together from its chunks."""
    ship(spark)
    recipes = _recipes(spark, path).withColumn("_row", F.concat_ws(":", "part", "local_start"))
    lines = recipes.select("_row", F.posexplode("hashes").alias("at", "hash")).join(_chunks(spark, path), "hash", "left")
    whole = lines.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "hash", "ids"))).alias("_chunks"))

    def build(batches):
        for batch in batches:
            columns = []
            for chunks, root in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                parts = [c["ids"] or b"" for c in chunks or []]
                if merkle_root([hashlib.sha256(p).digest() for p in parts]) != root:
                    raise ValueError("a document cannot be rebuilt from its recipe")
                columns.append(np.frombuffer(b"".join(parts), f"<u{width}").astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return recipes.join(whole, "_row", "left").select("doc_id", "start", "root", "_chunks").mapInArrow(build, "doc_id long, start long, ids array<int>")
