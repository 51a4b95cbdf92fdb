"""Added tokens in texts give the ids of the library, called plainly."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm.tokenstore import PieceTokenizer, read_digests, write_store

JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n don't", "<|endoftext|", "plain text, no marker", None, "", "ü <|endoftext|>  é"]


def test_added_tokens_equal_the_library(spark, tmp_path):
    library = Tokenizer.from_file(JSON)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert want[0] == [64, 220, 50256, 275]
    assert [x.tolist() for x in PieceTokenizer(JSON).encode_many(TEXTS)] == want
    write_store(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), f"file://{tmp_path}/a", JSON, 2)
    rows = sorted(read_digests(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.doc_id)
    ends = np.cumsum([len(x) + 1 for x in want])
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in rows] == [(int(e) - len(x) - 1, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for x, e in zip(want, ends)]


def test_new_pieces_go_to_the_library_as_lines_of_few_texts():
    """Pieces of all kinds, many at once; the plain ones cost one call for hundreds."""
    kinds = ["word{}", "W\u00f6rt{}", "{}", "don't{}'ll", "#{}$", " \u4e2d\u6587{}", "\u00b2{}", "a\u0301{}", "\U0001f600{}", "\u00a0x{}\u00a0", "\x1c{}\x85y", "\n\n {}\t ", "a  {}   b", "\r\nz{}\n", "\u180e{}\u200b", "\u2028p{}", "x\u0000{}"]
    texts = [" ".join(k.format(n * 7919) for k in kinds) for n in range(300)]
    library, own, sent = Tokenizer.from_file(JSON), PieceTokenizer(JSON), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **options)

    own.tokenizer = Counted()
    assert [x.tolist() for x in own.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.memo) > 500 and len(sent) < len(own.memo) / 10
