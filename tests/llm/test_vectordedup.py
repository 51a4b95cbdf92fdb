"""Near-duplicate vectors against all pairs in doubles."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import queries
from ledgerloom.llm import vectordedup as v

LARGER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n int"


def plain(ids, x):
    """vec_id -> (n_links, component_id), by all pairs."""
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    component = np.array(ids)
    while True:
        least = np.array([min([component[k], *component[linked[k]]]) for k in range(len(ids))])
        if (least == component).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), component)}
        component = least


def held(rows):
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows if r.vec_id is not None)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def planted(seed=5, d=24):
    """A tight group, a loose group, a chain, pairs and lone vectors; of different lengths, and some exact copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for noise, n in ((0.02, 300), (0.055, 200)):
        centre = rng.normal(size=d)
        centre /= np.sqrt(centre @ centre)
        rows += [centre + noise * rng.normal(size=d) for _ in range(n)]
    a, b = np.linalg.qr(rng.normal(size=(d, 2)))[0].T
    rows += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 2.5, 0.2)]
    for _ in range(40):
        x = rng.normal(size=d)
        rows += [x, 3 * x + 0.2 * rng.normal(size=d)]
    rows += list(rng.normal(size=(300, d)))
    x = np.array(rows).astype(np.float32)
    x = np.vstack([x, x[::9], x[:50] * 2])
    return rng.permutation(len(x)) + 100, x.astype(np.float64)


@pytest.mark.parametrize("group", [512, 64])
def test_links_equal_all_pairs(spark, group):
    ids, x = planted()
    table = spark.createDataFrame([(int(i), r.tolist(), 1, "r", 2) for i, r in zip(ids, x)], SCHEMA)
    rows = v.near_duplicate_vectors(table, miss=1e-6, group=group).collect()
    assert len(rows) == len(ids) and held(rows) == plain(ids, x)


def test_the_query_equals_all_pairs(spark):
    t = pq.read_table(f"{LARGER}/embeddings.parquet")
    assert held(queries.op13_vectordedup(spark, LARGER).collect()) == plain(np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), np.float64))


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(1)
    d, n = 64, 4000
    q = rng.normal(size=d)
    q /= np.sqrt(q @ q)
    e = rng.normal(size=(n, d))
    e -= (e @ q)[:, None] * q
    o = 0.95 * q + np.sqrt(1 - 0.95**2) * e / np.sqrt((e * e).sum(axis=1))[:, None]
    means = []
    for seed in range(60):  # unbiased over rotations, not over vectors under one of them
        codes = v.Codes(d, 4, 2, seed)
        packed, factor, _, _ = codes.of(o)
        _, _, sketch, step = codes.of(q[None, :])
        means.append((v.signs_of(packed, d) @ (sketch[0] * step[0]) / np.sqrt(d) / factor).mean())
        assert v.may_link(v.signs_of(packed, d), factor, sketch, step, 0.95).all()
    assert abs(np.mean(means) - 0.95) < 0.003
    far = rng.normal(size=(n, d))
    packed, factor, _, _ = codes.of(far / np.sqrt((far * far).sum(axis=1))[:, None])
    assert v.may_link(v.signs_of(packed, d), factor, sketch, step, 0.95).mean() < 0.01


def test_tables_grow_slowly_and_hold_the_chance_of_a_miss():
    for n in (10, 1000, 10**6, 10**9, 10**12):
        bits, tables = v.tables_for(n)
        same = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - same) ** tables <= v.MISS and n / 2**bits <= v.CROWD * 1.0001 or bits == v.MOST_BITS
    assert v.tables_for(10**9)[1] < 200


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (None, None), (9, [-1.0, 0.0]), (10, [3e-30, 0.0]), (11, None), (11, [1.0, 1.0])]
    found = v.near_duplicate_vectors(spark.createDataFrame([(i, e, 1, "r", 2) for i, e in rows], SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=repr) == sorted(
        [(0, 3, 0, True), (1, 3, 0, False), (3, 3, 0, False), (10, 3, 0, False), *[(i, 0, i, True) for i in (2, 4, 5, 6, 7, 8, 9, 11)], (None, 0, None, None), (None, 0, None, None)], key=repr
    )
    assert v.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert held(v.near_duplicate_vectors(spark.createDataFrame([(4, None, 1, "r", 2)], SCHEMA)).collect()) == {4: (0, 4)}
    with pytest.raises(ValueError):
        v.near_duplicate_vectors(spark.createDataFrame([(1, [1.0], 1, "r", 2), (2, [1.0, 2.0], 1, "r", 2)], SCHEMA)).count()
