"""Token operators against the public libraries and exact round trips."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerloom.llm import queries
from ledgerloom.llm.bpe import encode_checked, encode_digest, encode_documents, loaded
from ledgerloom.llm.tokencounts import count_tokens, write_flat
from ledgerloom.llm.tokenstore import crc32_joined, cuts, read_digests, read_documents, write_store

from .conftest import SF, counted

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_digests(rows, library):
    out = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return counted(out)


def test_bpe_equals_the_library(spark, texts, odd, odd_texts, none, library):
    assert counted(queries.op9_bpe(spark, SF).collect()) == brute_digests(texts, library)
    assert counted(encode_digest(odd, RANKS, PATTERN).collect()) == brute_digests(odd_texts, library)
    assert encode_digest(none, RANKS, PATTERN).count() == 0


def test_bpe_of_pieces_of_all_lengths(library):
    bpe = loaded(RANKS, PATTERN)
    pieces = ["ab" * k for k in range(1, 200, 7)] + ["é" * 3, "x" * 1000, "123456789" * 30, " ", "-" * 129, "-" * 128]
    found = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_pieces(pieces)]
    assert found == [library._encode_single_piece(p.encode()) for p in pieces]
    assert [bpe.decode(x).decode() for x in found] == pieces


def test_encoded_documents_keep_their_columns(odd, odd_texts, none, library):
    out = encode_documents(odd, RANKS, PATTERN)
    assert out.columns == [c for c in odd.columns if c != "ids"] + ["ids"]
    assert counted((r.doc_id, tuple(r.ids)) for r in out.collect()) == counted((i, tuple(library.encode_ordinary(t or ""))) for i, t in odd_texts)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in encode_checked(odd, RANKS, PATTERN).collect())
    assert encode_checked(none, RANKS, PATTERN).count() == 0


def brute_store(rows):
    tokenizer = Tokenizer.from_file(JSON)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_equals_the_library(spark, texts):
    assert counted(queries.op4_tokenstore(spark, SF).collect()) == counted(brute_store(texts))


def test_store_of_odd_rows(spark, odd, none, odd_texts, tmp_path):
    write_store(odd, f"file://{tmp_path}/a", JSON, 2)
    want = brute_store(odd_texts)
    found = read_digests(spark, f"file://{tmp_path}/a").collect()
    # Repeated doc_ids may stand in either order, so their starts are compared as sets of bounds.
    assert counted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == counted((r[0], r[2], r[3]) for r in want)
    bounds = sorted((r.start, r.start + r.n_tokens) for r in found)
    assert bounds[0][0] == 0 and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    whole = {(r.doc_id, r.start): r.ids for r in read_documents(spark, f"file://{tmp_path}/a").collect()}
    assert {k: zlib.crc32(np.array(v, "<u4").tobytes()) for k, v in whole.items()} == {(r.doc_id, r.start): r.ids_crc32 for r in found}
    write_store(none, f"file://{tmp_path}/b", JSON, 2)
    assert read_digests(spark, f"file://{tmp_path}/b").count() == 0


def test_a_store_names_each_chunk_once_and_notices_damage(spark, tmp_path):
    passage = " ".join(f"word{i * i % 977}" for i in range(3000))
    docs = spark.createDataFrame([(i, f"start {i} {passage} end {i}") for i in range(8)], "doc_id long, text string").repartition(4)
    path = f"file://{tmp_path}/s"
    write_store(docs, path, JSON, 2)
    chunks = spark.read.parquet(f"{path}/data/kind=chunk").select("hash", "ids")
    assert chunks.count() == chunks.select("hash").distinct().count()
    stored = chunks.selectExpr("sum(length(ids)) / 2").first()[0]
    assert stored < 0.4 * sum(r.n_tokens for r in read_digests(spark, path).collect())
    kept = chunks.limit(chunks.count() - 1).collect()
    spark.createDataFrame(kept, "hash binary, ids binary").write.mode("overwrite").parquet(f"{path}/data/kind=other")
    (tmp_path / "s" / "data" / "kind=chunk").rename(tmp_path / "was")
    (tmp_path / "s" / "data" / "kind=other").rename(tmp_path / "s" / "data" / "kind=chunk")
    with pytest.raises(Exception, match="cannot be rebuilt"):
        read_digests(spark, path).collect()


@pytest.mark.parametrize("change", ["n_tokens + 1 AS n_tokens", "local_start + 1 AS local_start", "transform(counts, x -> x + 1) AS counts", "doc_id + 1 AS doc_id"])
def test_damage_to_recipes_is_noticed(spark, tmp_path, change):
    path, name = f"file://{tmp_path}/s", change.split()[-1]
    write_store(spark.range(30).selectExpr("id AS doc_id", "concat('some text of document ', id) AS text"), path, JSON, 2)
    assert read_digests(spark, path).count() == 30
    recipes = spark.read.parquet(f"{path}/recipes")
    changed = [change if c == name else c for c in recipes.columns]
    recipes.where("doc_id <> 7").unionByName(recipes.where("doc_id = 7").selectExpr(*changed).to(recipes.schema)).write.parquet(f"{path}/other")
    (tmp_path / "s" / "recipes").rename(tmp_path / "was")
    (tmp_path / "s" / "other").rename(tmp_path / "s" / "recipes")
    with pytest.raises(Exception, match="differs from its manifest|cannot be rebuilt"):
        read_digests(spark, path).collect()


def test_chunks_follow_content():
    ids = np.random.default_rng(1).integers(0, 50_000, 40_000).astype(np.uint32)
    a, b = cuts(ids), cuts(np.concatenate([ids[:100] + 1, ids]))
    assert a[-1] == len(ids) and len({x + 100 for x in a} & set(b)) > 0.9 * len(a)
    data = ids.tobytes()
    assert crc32_joined([(zlib.crc32(data[:4001]), 4001), (zlib.crc32(data[4001:]), len(data) - 4001)]) == zlib.crc32(data)


def test_separator_scan_counts_every_document(spark, texts, odd, odd_texts, none, library, tmp_path):
    found = queries.op8_tokencounts(spark, SF).collect()
    assert sorted(r.n_tokens for r in found) == sorted(len(library.encode_ordinary(t or "")) for _, t in texts)
    assert sorted(r.doc_no for r in found) == list(range(len(texts)))
    write_flat(odd.repartition(3), f"file://{tmp_path}/a", RANKS, PATTERN)
    for block in (1 << 20, 1000, 7):  # the smaller the block, the more documents cross borders
        rows = sorted(count_tokens(spark, f"file://{tmp_path}/a", block=block).collect(), key=lambda r: r.start)
        assert sorted(r.n_tokens for r in rows) == sorted(len(library.encode_ordinary(t or "")) for _, t in odd_texts)
        assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens + 1 for r in rows[:-1])]).tolist()
    write_flat(none, f"file://{tmp_path}/b", RANKS, PATTERN)
    assert count_tokens(spark, f"file://{tmp_path}/b").count() == 0


def test_flat_files_are_bounded_by_bytes_and_keep_order(spark, odd_texts, library, tmp_path):
    schema = "k long, text string"
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(odd_texts)], schema).coalesce(1).orderBy("k")
    sizes = [len(library.encode_ordinary(t or "")) for _, t in odd_texts]
    write_flat(docs, f"file://{tmp_path}/c", RANKS, PATTERN, file_bytes=200)
    lengths = [f.stat().st_size for f in sorted((tmp_path / "c").glob("part-*"))]
    assert len(lengths) > 1 and sum(lengths) == 2 * sum(n + 1 for n in sizes)
    assert all(n < 200 + 2 * (max(sizes) + 1) for n in lengths)
    rows = sorted(count_tokens(spark, f"file://{tmp_path}/c", block=50).collect(), key=lambda r: r.doc_no)
    assert [r.n_tokens for r in rows] == sizes
