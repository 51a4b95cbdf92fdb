"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 6).

The measure is the inner product. Vectors get one more component so that all have the same norm; then the nearest by
Euclidean distance is the one of largest inner product, and Gaussian (2-stable) projections, cut into steps, are a hash
family for it. A query visits, in every table, the buckets around its own in the order of their estimated success: the
smaller the distance from the query's projections to a bucket's borders, the earlier. Candidates of all tables merge and
are ranked by their exact inner product.

Buckets are dealt to groups of about GROUP vectors; a group that a common bucket makes larger is split by vec_id, and
queries go to each of its parts. So no task holds a bucket of unbounded size, no vector is left out, and no pair is ever
a row: products are taken in blocks, and only each block's best 20 leave it. A task's memory is that of GROUP vectors,
half as many queries and one block, whatever the size of the table.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import ship, staged

TABLES, HASHES, WIDTH, PROBES, NEAREST, SEED = 8, 6, 1.5, 128, 20, 11
#: Vectors of a group; half as many queries meet them at once. A query goes to most groups of a table, so few large ones cost less.
GROUP = 65_536
#: Products taken at once, and those of them that are taken again exactly at once.
BLOCK, EXACT = 1 << 20, 1 << 14
#: A product within this (times both norms) of the least that counts is taken again exactly; block products round differently by shape.
SLACK = 1e-9


class Hashes:
    """The hash functions for vectors of one dimension, and the order in which a query's buckets are visited."""

    def __init__(self, dimension: int, most: float, tables: int, hashes: int, width: float, seed: int):
        random = np.random.default_rng(seed)
        self.most, self.tables, self.width = most, tables, width * most
        self.directions = random.normal(size=(tables, hashes, dimension + 1))
        self.shifts = random.uniform(0, self.width, size=(tables, hashes))
        self.steps = np.array(list(product((0, -1, 1), repeat=hashes)), np.int64)
        self.factors = random.integers(1, 1 << 62, size=hashes, dtype=np.int64) | 1

    def _places(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.directions[table].T + self.shifts[table]) / self.width

    def _codes(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.factors).sum(axis=-1)

    def _evened(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        if query:
            return np.hstack([x / norm * self.most, np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.most**2 - norm**2))])

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Codes of the vectors' buckets: one row for each vector, one column for each table."""
        x = self._evened(x, False)
        return np.stack([self._codes(np.floor(self._places(x, t)).astype(np.int64)) for t in range(self.tables)], axis=1)

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """Codes of the n buckets of a table that the queries visit, best first."""
        places = self._places(self._evened(x, True), table)
        cells = np.floor(places)
        inside = places - cells
        cost = np.stack([np.zeros_like(inside), (1 - inside) ** 2, inside**2], axis=2)  # by step 0, 1, -1: a step is its index
        total = sum(cost[:, i, self.steps[:, i]] for i in range(self.steps.shape[1]))
        best = np.argsort(total, axis=1, kind="stable")[:, :n]
        return self._codes(cells.astype(np.int64)[:, None, :] + self.steps[best])


def _valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and x (floats as they are, anything else as doubles) of the vectors that take part."""
    v = F.col(vector)
    plain = v if vectors.schema[vector].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    ok = v.isNotNull() & F.col(vec_id).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), plain.alias("x"))


def _matrix(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype("<f8", copy=False)


def best_of(points: np.ndarray, point_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, meets: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, list[int], list[float]]]:
    """Each query's n nearest among what it meets: pairs of rows of points and rows of queries, all of one with all of the other."""
    least = np.full(len(queries), -np.inf)
    slack = SLACK * np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((points * points).sum(axis=1).max(initial=0.0))
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def settle():
        nonlocal held, fresh, waiting
        q, p, s = (np.concatenate([h, *[f[k] for f in fresh]]) for k, h in enumerate(held))
        order = np.lexsort((point_ids[p], -s, q))
        q, p, s = q[order], p[order], s[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < n
        held, fresh, waiting = [q[keep], p[keep], s[keep]], [], 0
        full = np.flatnonzero(np.bincount(held[0], minlength=len(queries)) == n)
        if len(full):
            last = np.searchsorted(held[0], full, side="right") - 1
            least[full] = held[2][last]

    def exact(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", queries[q[a : a + EXACT]], points[p[a : a + EXACT]]) for a in range(0, len(q), EXACT)]
        return np.concatenate(parts)

    def blocks():
        for p_rows, q_rows in meets:
            for a in range(0, len(p_rows), BLOCK):
                some = p_rows[a : a + BLOCK]
                step = max(1, BLOCK // len(some))
                for b in range(0, len(q_rows), step):
                    yield some, q_rows[b : b + step]

    for p_rows, part in blocks():
        products = queries[part] @ points[p_rows].T
        near = products >= (least[part] - slack[part])[:, None]
        if np.count_nonzero(near) > 2 * n * len(part) and len(p_rows) > n + 1:
            # Of the block's own products the best n count, and one more, as the query itself may be among them.
            own = np.partition(products, -(n + 1), axis=1)[:, -(n + 1)]
            near &= products >= (own - 2 * slack[part])[:, None]
        i, j = np.nonzero(near)
        q, p = part[i], p_rows[j]
        other = query_ids[q] != point_ids[p]
        q, p = q[other], p[other]
        if len(q):
            fresh.append((q, p, exact(q, p)))
            waiting += len(q)
        if waiting > 1 << 18:
            settle()
    settle()
    out, ends = [], np.flatnonzero(np.diff(held[0], append=-1))
    start = 0
    for end in ends.tolist() if len(held[0]) else []:
        rows = slice(start, end + 1)
        out.append((int(query_ids[held[0][end]]), point_ids[held[1][rows]].tolist(), held[2][rows].tolist()))
        start = end + 1
    return out


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, n: int = NEAREST, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: each query's n nearest found, ties to the smaller vec_id.

    Queries are the vectors whose vec_id is divisible by every; candidates are all but the query itself. Null and zero
    vectors and those with a null or non-finite component take no part, nor do rows without a vec_id. Repeated rows
    (same vec_id) count once. All vectors must have one dimension. A query for which the probes find fewer than n is
    searched again over everything, so it gets all candidates there are. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    valid = staged(_valid(vectors, vec_id, vector).dropDuplicates(["vec_id"]), "vectors")
    kind = "<f4" if valid.schema["x"].dataType.simpleString() == "array<float>" else "<f8"
    norm = F.sqrt(F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda a, b: a + b * b))
    facts = valid.agg(F.count("*"), F.max(F.size("x")), F.min(F.size("x")), F.max(norm)).first()
    if not facts[0]:
        return spark.createDataFrame([], schema)
    if facts[1] != facts[2]:
        raise ValueError("vectors differ in dimension")
    family = Hashes(facts[1], facts[3], tables, hashes, width, seed)
    split = max(1, -(-facts[0] // GROUP))  # groups of a table

    def index(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            codes = family.buckets(x.astype("<f8")) if len(ids) else np.empty((0, tables), np.int64)
            raw = [row.tobytes() for row in x.astype(kind)]
            for t in range(tables):
                group = t * split + (codes[:, t].astype(np.uint64) >> np.uint64(17)) % np.uint64(split)
                yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int64)), pa.array(codes[:, t]), pa.array(ids), pa.array(raw, pa.binary())], ["g", "code", "vec_id", "x"])

    def visit(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keep = np.flatnonzero(ids % every == 0)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[keep]
            for start in range(0, len(keep), 1024):
                part, own = x[start : start + 1024], ids[keep[start : start + 1024]].tolist()
                raw = [row.tobytes() for row in part.astype(kind)]
                for t in range(tables):
                    codes = family.probes(part.astype("<f8"), t, probes)
                    groups = (codes.astype(np.uint64) >> np.uint64(17)) % np.uint64(split)
                    rows = [(t * split + int(g), c[h == g].tolist(), i, r) for c, h, i, r in zip(codes, groups, own, raw) for g in np.unique(h)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["g", "codes", "query_id", "q"])

    points = staged(valid.mapInArrow(index, "g long, code long, vec_id long, x binary"), "points")
    queries = staged(valid.where(F.col("vec_id") % every == 0).mapInArrow(visit, "g long, codes array<long>, query_id long, q binary"), "probes")
    parts = points.groupBy("g").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))

    def search(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "s": pd.Series(dtype=object), "v": pd.Series(dtype=object)})
        codes, rows = p["code"].to_numpy(), np.arange(len(p))
        order = np.argsort(codes, kind="stable")
        names, starts = np.unique(codes[order], return_index=True)
        buckets = np.split(order, starts[1:])
        wanted: dict[int, list[int]] = {}
        everything = []
        for k, c in enumerate(q["codes"]):
            if c is None:
                everything.append(k)
            else:
                for code in c:
                    wanted.setdefault(int(code), []).append(k)
        meets = [(b, np.array(wanted[c])) for c, b in zip(names.tolist(), buckets) if c in wanted]
        if everything:
            meets.append((rows, np.array(everything)))
        found = best_of(_matrix(p["x"], kind), p["vec_id"].to_numpy(), _matrix(q["q"], kind), q["query_id"].to_numpy(), meets, n)
        negated = [[-s for s in f[2]] for f in found]  # so that ascending order puts the nearest first
        return pd.DataFrame({"query_id": pd.Series([f[0] for f in found], dtype="int64"), "s": pd.Series(negated, dtype=object), "v": pd.Series([f[1] for f in found], dtype=object)})

    def searched(q: DataFrame) -> DataFrame:
        # A hot group's vectors and queries are both cut up; every part of the ones meets every chunk of the others.
        chunks = q.groupBy("g").agg(F.ceil(F.count("*") * 2 / GROUP).cast("int").alias("chunks"))
        sizes = parts.join(chunks, "g")
        dealt = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
        p = points.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).withColumn("chunk", dealt("chunks")).drop("parts", "chunks")
        q = q.join(sizes, "g").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks")).withColumn("part", dealt("parts")).drop("parts", "chunks")
        block = ("g", "part", "chunk")
        each = p.groupBy(*block).cogroup(q.groupBy(*block)).applyInPandas(search, "query_id long, s array<double>, v array<long>").select("query_id", F.arrays_zip("s", "v").alias("found"))
        # At most n from each part that a query visited.
        merged = each.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, n).alias("found"))
        return merged

    found = staged(searched(queries), "nearest")
    few = valid.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x")
    few = few.join(found.where(F.size("found") >= min(n, facts[0] - 1)).select("query_id"), "query_id", "left_anti")
    if not few.isEmpty():
        again = queries.groupBy("query_id").agg(F.first("q").alias("q")).join(few.select("query_id"), "query_id", "left_semi")
        groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(split - 1).cast("long")))  # table 0 holds every vector once
        again = again.select(groups.alias("g"), F.lit(None).cast("array<long>").alias("codes"), "query_id", "q")
        found = found.join(few.select("query_id"), "query_id", "left_anti").unionByName(searched(again))
    rows = found.select("query_id", F.posexplode("found").alias("at", "f"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.v").alias("vec_id"), (-F.col("f.s")).alias("score"))
