"""Pieces cut, numbered and chunked as columns give what single texts give."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from ledgerloom.llm import tokenstore
from ledgerloom.llm.pretokens import byte_level_cuts
from ledgerloom.llm.tokenstore import PieceTokenizer, _slices, cuts, cuts_of

JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIGNS = ["'", "'", "s", "t", "re", "ve", "ll", "l", " ", " ", "  ", "\n", "\r\n", "\t", " ", "　", " ", "é", "中", "\U0001f600", "\U00010400", "1", "²", "٣", "á", ".", "-", "\x1c", "\x85", "᠎", "​", "S", "\x00"]


def test_cuts_into_pieces_equal_the_pattern():
    draw = random.Random(3)
    for _ in range(3000):
        texts = ["".join(draw.choices(SIGNS, k=draw.choice([0, 1, 2, 3, 5, 9, 20]))) for _ in range(draw.choice([1, 2, 7]))]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
        cut = byte_level_cuts(data, bounds[:-1][bounds[1:] > bounds[:-1]])
        found = [data[x:y].tobytes().decode() for x, y in zip(cut, [*cut[1:], len(data)])]
        assert found == [p for t in texts for p in regex.findall(PATTERN, t)], texts


def test_chunks_of_many_streams_equal_those_of_each():
    draw = np.random.default_rng(5)
    streams = [draw.integers(0, 50_000, n).astype("<u4") for n in (0, 1, 127, 128, 129, 140, 5000, 0, 70_000, 300)] + [np.zeros(9000, "<u4")]
    bounds = np.cumsum([0, *map(len, streams)])
    assert list(cuts_of(np.concatenate(streams), bounds)) == [cuts(s) for s in streams]


def test_python_sees_each_piece_of_a_slice_once(monkeypatch):
    """Work in Python goes with the distinct pieces, not with the length of the texts; the memo stays within its bounds."""
    own, library, seen = PieceTokenizer(JSON), Tokenizer.from_file(JSON), []
    numbers = own._numbers
    monkeypatch.setattr(own, "_numbers", lambda pieces: seen.extend(pieces) or numbers(pieces))
    texts = [" ".join(f"word{k % 50} don't" for k in range(2000)), None, "", " word7"]
    assert [x.tolist() for x in own.encode_many(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(seen) == len(set(seen)) < 200
    monkeypatch.setattr(tokenstore, "MEMO_CHARACTERS", 1000)
    for k in range(5):
        long = [f"{'x' * 900}{k} and a {'y' * 900}{k}"]
        assert [x.tolist() for x in own.encode_many(long)] == [library.encode(long[0], add_special_tokens=False).ids]
        assert own.characters < 3000


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(tokenstore, "SLICE", 10)
    texts = pa.array(["aaaa", None, "bbbbbb", "c", "", "é" * 20, None, "d"], pa.string()).slice(1)
    parts = list(_slices(texts))
    assert [t for p in parts for t in p.to_pylist()] == texts.to_pylist()
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 10 for p in parts)
    own, library = PieceTokenizer(JSON), Tokenizer.from_file(JSON)
    for p in parts:
        ids, bounds = own.encode_joined(p)
        assert [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in p.to_pylist()]


def test_large_strings_are_taken():
    own, texts = PieceTokenizer(JSON), ["some words", None, "é <|endoftext|> x", "", "don't"]
    want = [x.tolist() for x in own.encode_many(texts)]
    parts = [own.encode_joined(p) for p in _slices(pa.array(texts, pa.large_string()))]
    assert [ids[x:y].tolist() for ids, bounds in parts for x, y in zip(bounds, bounds[1:])] == want
