"""Neighbour search against exact search, language of pages on labelled pages, and the pipeline."""

import tracemalloc

import numpy as np
import pyarrow.parquet as pq

from ledgerloom.llm import queries
from ledgerloom.llm.ann import best_of, nearest
from ledgerloom.llm.langid import declared_language, identify, page_text

from .conftest import SF

LARGER = "/root/testdata/sf0.01"


def exact(ids, x, n=20):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = np.einsum("ij,j->i", x, x[q])
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != ids[q]][:n]
        out[int(ids[q])] = [(int(ids[k]), s[k]) for k in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_neighbours_reach_their_recall(spark):
    t = pq.read_table(f"{LARGER}/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), np.float64)
    want, found = exact(ids, x), by_query(queries.op6_neighbours(spark, LARGER).collect())
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    hits = [len({a for a, _ in found[q]} & {a for a, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    at = {int(i): k for k, i in enumerate(ids)}
    for q, rows in found.items():
        scores = [s for _, s in rows]
        assert all(a > b or (a == b and rows[k][0] < rows[k + 1][0]) for k, (a, b) in enumerate(zip(scores, scores[1:])))
        assert all(abs(s - x[at[q]] @ x[at[v]]) < 1e-12 for v, s in rows)


def test_neighbours_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 1.0], 1), (1, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (40, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1)]
    found = by_query(nearest(spark.createDataFrame(rows, schema)).collect())
    assert found == {0: [(1, 2.0), (2, 2.0), (20, 1.0)], 20: [(1, 2.0), (2, 2.0), (0, 1.0)]}
    assert nearest(spark.createDataFrame([], schema)).count() == 0


def test_a_bucket_of_copies_is_searched_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [1.0, 0.5, 0.25, 0.0]) for k in range(400)] + [(k, rng.normal(size=4).tolist()) for k in range(400, 800)]
    found = by_query(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert [v for v, _ in found[20] if v < 400] == [k for k in range(400) if k != 20][: len([v for v, _ in found[20] if v < 400])]
    assert all(len(v) == 20 for v in found.values())


def test_a_hot_bucket_is_cut_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, (np.array([1.0, 0.5, 0.25, 0.0]) + rng.normal(size=4) / 1000).tolist()) for k in range(600)] + [(k, rng.normal(size=4).tolist()) for k in range(600, 700)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = by_query(nearest(vectors).collect())
    monkeypatch.setattr("ledgerloom.llm.ann.GROUP", 16)  # 600 vectors and 30 queries of one bucket
    cut = by_query(nearest(vectors).collect())
    for q in range(0, 600, 20):
        assert {v for v, _ in whole[q]} == {v for v, _ in cut[q]} and len(cut[q]) == 20
    assert whole.keys() == cut.keys()


def test_a_block_of_neighbours_takes_bounded_memory():
    rng = np.random.default_rng(7)
    points, queries = rng.normal(size=(600, 64)), rng.normal(size=(1500, 64))
    points[300:], queries[:5] = points[0], points[0]  # copies, more than count
    meets = [(np.arange(600), np.arange(1500))]
    tracemalloc.start()
    found = {q: (v, s) for q, v, s in best_of(points, np.arange(600), queries, np.arange(1000, 2500), meets, 20)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # 900,000 products; their vectors side by side would take 920 MB
    products = np.einsum("ij,kj->ik", queries, points)
    for k in range(1500):
        best = sorted(range(600), key=lambda j: (-products[k, 0 if j >= 300 else j], j))[:20]
        assert found[1000 + k][0] == best
        assert np.allclose(found[1000 + k][1], products[k, best], rtol=0, atol=1e-9)


def test_language_of_labelled_pages(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang")
    known = [r for r in docs.where("lang in ('de', 'en', 'es', 'fr') and length(text) > 300").orderBy("doc_id").collect()][-200:]
    pages = [(r.doc_id, f"https://site{r.doc_id % 7}.example.org/{r.doc_id}", f"<html><body><p>{r.text}</p></body></html>") for r in known]
    others = docs.join(spark.createDataFrame([(r.doc_id,) for r in known], "doc_id long"), "doc_id", "left_anti")
    found = {r.page_id: r.lang for r in identify(spark.createDataFrame(pages, "page_id long, url string, html string"), others).collect()}
    assert len(found) == len(known)
    assert np.mean([found[r.doc_id] == r.lang for r in known]) > 0.9


def test_language_of_odd_pages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pages = [(1, None, None), (1, None, None), (None, "http://a.de/", ""), (2, "not an address", "<html lang='fr'>"), (3, "https://x.example.fr/", "<html lang=\"fr\"><body>" + "le la les des et " * 20000 + "</body></html>")]
    schema = "page_id long, url string, html string"
    found = identify(spark.createDataFrame(pages, schema), docs).collect()
    assert len(found) == 5 and {r.lang for r in found if r.page_id == 3} == {"fr"}
    assert all(0 < r.confidence <= 1 for r in found)
    assert identify(spark.createDataFrame([], schema), docs).count() == 0
    assert identify(spark.createDataFrame(pages, schema), docs.limit(0)).count() == 5
    assert queries.op2_language(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_markup_is_left_out():
    assert page_text("<p>a &amp; b</p><script>x()</script><!-- c -->").split() == ["a", "&", "b"]
    assert declared_language('<!doctype html><html class="a" lang="DE-at">') == "de"


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    from .test_dedup_mix import brute
    from .test_scans import brute_base

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "personal_data", "mixing", "token_ids"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
        if name == "near_dedup":
            rows = brute([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in kept.collect()) == sorted({r[2] for r in rows})
        if name == "personal_data":
            assert not any(brute_base(r.text) for r in kept.collect())
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == kept.count() and all(r.round_trip for r in out)
