"""Documents that the corpus tests share."""

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string, row string, ids string, size string"

PROSE = "the quick brown fox of the town went to the mill and in the evening it was that a man is back "
ODD = [
    (1, PROSE * 8, "en", "web", 1, "x", "r", "i", "s"),
    (2, PROSE * 8, "en", "web", 1, "x", "r", "i", "s"),
    (2, PROSE * 8, "en", "web", 1, "x", "r", "i", "s"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "de", "web", 0, None, None, None, None),
    (5, " \t\n ", "fr", "", 4, None, None, None, None),
    (None, "no id here", "en", "web", 10, None, None, None, None),
    (None, PROSE * 8, "en", "web", 10, None, None, None, None),
    (6, "x" * 300_000 + " " + "1" * 50_000, "zz", "books", 350_001, None, None, None, None),
    (7, "mail bob@example.org or b@ x@y.z, call +1 (555) 010-9999, card 4111 1111 1111 1111, ip 10.1.2.300 1.2.3.4.5", "en", "web", 5, None, None, None, None),
    (8, "Ünïcode 𝒳 a@b.cc 😀 12.34.56.78\x0b+49 30 1234567 4111-1111-1111-1112 CC BY 4.0 all rights reserved", "de", "web", 5, None, None, None, None),
    (9, "Licensed under the Apache License, Version 2.0. GNU General Public License cc by cc by", "en", "code", 5, None, None, None, None),
    (10, "a b c a b c\na b c\n\na b c\nd", "en", "code", 5, None, None, None, None),
    (11, "One two three\r\n'll we've      x́ ١٢٣ don't   ", "en", "code", 5, None, None, None, None),
    (12, "two words", "en", "code", 5, None, None, None, None),
    (13, "TWO WORDS", "en", "code", 5, None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def texts():
    """doc_id and text of the small table."""
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="session")
def odd_texts():
    return [(r[0], r[1]) for r in ODD]


def counted(rows):
    """Rows as a sorted list that keeps repeats."""
    return sorted((tuple(r) for r in rows), key=repr)
