"""The word rule of quality over all words: what has no common words is far."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from ledgerloom.llm import queries
from ledgerloom.llm.quality import judged, keep_good

from .conftest import SF, counted


def test_texts_without_common_words_are_rejected_whatever_their_length(spark):
    salad = " ".join(f"{chr(97 + k % 26)}{chr(97 + k * 7 % 26)}rgol{chr(97 + k * k % 26)}mun" for k in range(300)) + "."
    wrong = "der Hund und die Katze gehen mit den Kindern zu dem Haus, das von der Stadt in das Tal führt. " * 3
    words = "river stone garden letter morning window winter summer market bridge song horse house paper silver".split()
    good = " ".join((f'"{words[k * k % 15]}"', "the,", words[k % 13], "of", words[k * 3 % 15], "and" if k % 2 else "To", words[k * k % 11], "in" if k % 3 else "a", words[k % 7], words[k % 15], words[k * k * k % 15])[k % 11] for k in range(400))
    docs = spark.createDataFrame([(1, salad, "en"), (2, salad[:1200], "en"), (3, wrong, "en"), (4, good, "en")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in judged(docs).collect()}
    assert all(rows[k].word_distance > 0.28 and not rows[k].kept for k in (1, 2, 3))
    assert rows[4].word_distance < 0.28
    assert not {1, 2, 3} & {r.doc_id for r in keep_good(docs).collect()}


def test_labelled_good_texts_are_near(spark):
    sf = "/root/testdata/sf0.01"
    good = {r["doc_id"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["quality"] == 1}
    rows = [r for r in judged(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in good and not r.base_failed]
    assert len(rows) > 300 and max(r.word_distance for r in rows) < 0.28


def test_the_query_rejects_what_has_no_common_words_as_its_sql_does(spark, tmp_path):
    salad = " ".join(f"{chr(97 + k % 26)}{chr(97 + k * 7 % 26)}rgol{chr(97 + k * k % 26)}mun" for k in range(300)) + "."
    rows = [*pq.read_table(f"{SF}/documents.parquet").to_pylist(), {"doc_id": -1, "text": salad, "lang": "en"}, {"doc_id": -2, "text": salad + " (The) 'of' AND", "lang": "de"}, {"doc_id": -3, "text": None, "lang": None}]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    found = queries.op10_quality(spark, f"file://{tmp_path}")
    assert counted(found.collect()) == counted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.oracle_sql()['op10_quality']})").fetchall())
    assert {r.doc_id: r.kept for r in found.where("doc_id < 0").collect()} == {-1: False, -2: False, -3: False}
