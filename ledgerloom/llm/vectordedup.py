"""Near-duplicates among embeddings by randomised-rotation binary codes (operator 13).

A unit vector o is rotated by a random orthogonal matrix and kept as its signs: the code b, read as the unit vector
b / sqrt(D). With the stored correction factor f = <b / sqrt(D), o'> the quotient <b / sqrt(D), q'> / f is an unbiased
estimate of <o, q>, and its error is that of a random direction: given the cosine c, at most
EPSILON * sqrt(1 - c^2) * sqrt((1 - f^2) / f^2) / sqrt(D - 1) but with a chance that falls as exp(-EPSILON^2 / 2).
The other side of an estimate is kept in 8 bits a component; half a step of each is added to the bound.

1. Equal vectors become one (class of copies). Signs of further rotations give the keys of hash tables; keys have as many
   bits as leave CROWD vectors to a bucket of random vectors, and as many tables are made as leave a pair at the
   threshold a chance of MISS to share no bucket. Only codes and 8-bit sketches travel, no vectors.
2. In a bucket, pairs whose upper bound reaches the threshold are candidates; the bucket gives each of its members the
   smallest one that candidates connect it to, never pairs. A bucket of over GROUP members is one class unseen.
3. Candidates' components are classes. Vectors are shuffled once, by class; estimate and bound decide again which pairs
   are recomputed, in doubles, and links are counted. In a class of over GROUP vectors those so near its centre that any
   two must link are counted by number; only the others meet all of the class, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.shared import ship, staged

THRESHOLD, MISS, CROWD, GROUP, EPSILON, SEED = 0.95, 1e-4, 64, 512, 6.0, 13
#: Longest key; more bits than 2^40 vectors ask for.
MOST_BITS = 40
#: Products taken at once.
BLOCK = 1 << 21
#: A vector is in a class's core only if it is this much nearer the centre than two linked vectors need, for rounding.
CORE_SLACK = 1e-6


def tables_for(n: int, threshold: float = THRESHOLD, miss: float = MISS, crowd: int = CROWD) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors."""
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2.0, n / crowd)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


class Codes:
    """Rotations for vectors of one dimension; makes codes, correction factors, sketches and table keys."""

    def __init__(self, dimension: int, bits: int, tables: int, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.d, self.bits, self.tables = dimension, bits, tables
        n = 1 + -(-bits * tables // dimension)
        self.rotations = [np.linalg.qr(random.normal(size=(dimension, dimension)))[0] for _ in range(n)]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes, factors, sketches (int8), steps of the sketches; x are unit vectors."""
        turned = x @ self.rotations[0]
        signs = turned > 0
        factor = np.abs(turned).sum(axis=1) / math.sqrt(self.d)
        step = np.maximum(np.abs(turned).max(axis=1), 1e-30) / 127
        return np.packbits(signs, axis=1), factor, np.rint(turned / step[:, None]).astype(np.int8), step

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One key for each table: its own bits among the signs of the further rotations."""
        signs = np.hstack([x @ r for r in self.rotations[1:]])[:, : self.bits * self.tables] > 0
        weights = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        return signs.reshape(len(x), self.tables, self.bits) @ weights


def signs_of(codes: np.ndarray, dimension: int) -> np.ndarray:
    """Packed codes as rows of -1 and 1."""
    return np.unpackbits(codes, axis=1, count=dimension).astype(np.float32) * 2 - 1


def may_link(codes: np.ndarray, factor: np.ndarray, sketch: np.ndarray, step: np.ndarray, threshold: float, epsilon: float = EPSILON) -> np.ndarray:
    """Matrix that says of each code (row) and sketch (column) whether the upper bound of their cosine reaches the threshold.

    codes are rows of -1 and 1, sketch the 8-bit rows; the bound supposes a cosine at the threshold.
    """
    d = codes.shape[1]
    estimate = (codes @ sketch.astype(np.float32).T) * (step.astype(np.float32)[None, :] / np.float32(math.sqrt(d))) / factor.astype(np.float32)[:, None]
    random = epsilon * math.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(1, d - 1))
    rounding = step[None, :] / 2 * math.sqrt(d) / factor[:, None] + 1e-5
    return estimate >= threshold - random[:, None] - rounding


def least_connected(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> np.ndarray:
    """For each of n members the smallest id that pairs (rows i, j) connect it to, itself included."""
    label = ids.copy()
    if not pairs:
        return label
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    place = np.argsort(ids, kind="stable")
    at = np.empty(n, np.int64)
    at[place] = np.arange(n)  # members by ascending id, so that the root of least place has the least id
    root = np.arange(n)
    i, j = at[i], at[j]
    while len(i):
        np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return ids[place][root[at]]


def _doubles(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def _packed_bytes(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def _sketches(pdf: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
    return signs_of(codes, d), pdf["factor"].to_numpy(), np.frombuffer(b"".join(pdf["sketch"]), np.int8).reshape(len(pdf), -1), pdf["step"].to_numpy()


def classes_of_copies(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """members (vec_id, rep) and reps (rep, copies, x: unit vector in doubles, as bytes).

    Members are the vec_ids whose vector takes part: not null, not zero, all components there and finite. A vec_id on
    several rows counts once, with the least of its vectors. rep is the least vec_id of equal vectors.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    ok = F.col(f"`{vec_id}`").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"), ok.alias("ok")).where("ok").groupBy("vec_id").agg(F.min("v").alias("v"))
    valid = staged(valid, "valid")
    groups = staged(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "copies")
    sizes = groups.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError("vectors differ in dimension")
    members = valid.join(groups.select("v", "rep"), "v").select("vec_id", "rep")

    def unit(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed_bytes(x.astype("<f8"))], ["rep", "copies", "x"])

    return members, staged(groups.select("rep", "copies", "v").mapInArrow(unit, "rep long, copies long, x binary"), "units")


def candidate_classes(reps: DataFrame, dimension: int, n: int, threshold: float = THRESHOLD, miss: float = MISS, crowd: int = CROWD, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """node and component of every rep that is a candidate with another; reps are rep and x."""
    codes = Codes(dimension, *tables_for(n, threshold, miss, crowd), seed)

    def code(batches):
        for batch in batches:
            x = _doubles(batch.column(1).to_pylist()) if batch.num_rows else np.empty((0, dimension))
            packed, factor, sketch, step = codes.of(x)
            keys = codes.keys(x)
            columns = [batch.column(0), _packed_bytes(packed), pa.array(factor), _packed_bytes(sketch), pa.array(step)]
            for t in range(codes.tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(keys[:, t]), *columns], ["t", "key", "rep", "code", "factor", "sketch", "step"])

    coded = staged(reps.select("rep", "x").mapInArrow(code, "t int, key long, rep long, code binary, factor double, sketch binary, step double"), "coded")
    sizes = coded.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1")
    crowded = coded.join(sizes.where(f"n > {group}"), ["t", "key"]).where("rep <> least").selectExpr("rep a", "least b")
    plain = coded.join(sizes.where(f"n <= {group}").select("t", "key"), ["t", "key"])

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["rep"].to_numpy()
        signs, factor, sketch, step = _sketches(pdf, dimension)
        pairs = []
        width = max(1, BLOCK // len(ids))
        for a in range(0, len(ids), width):
            part = slice(a, a + width)
            i, j = np.nonzero(may_link(signs[part], factor[part], sketch, step, threshold))
            pairs.append((i[i + a != j] + a, j[i + a != j]))
        least = least_connected(len(ids), pairs, ids)
        moved = least != ids
        return pd.DataFrame({"a": ids[moved], "b": least[moved]})

    links = plain.groupBy("t", "key").applyInPandas(bucket, "a long, b long").unionByName(crowded).distinct()
    return connected_components(links)


def exact_links(left: pd.DataFrame, right: pd.DataFrame, codes: Codes, threshold: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For each row of left, how many vectors of right (copies counted, itself not) it links to; and the pairs (rows)."""
    a, b = _doubles(left["x"]), _doubles(right["x"])
    left_ids, right_ids, copies = left["rep"].to_numpy(), right["rep"].to_numpy(), right["copies"].to_numpy()
    packed, factor, _, _ = codes.of(a)
    signs, (_, _, sketch, step) = signs_of(packed, codes.d), codes.of(b)
    counts, pairs, width = np.zeros(len(a), np.int64), [], max(1, BLOCK // max(1, len(b)))
    for start in range(0, len(a), width):
        part = slice(start, start + width)
        i, j = np.nonzero(may_link(signs[part], factor[part], sketch, step, threshold))
        i += start
        other = left_ids[i] != right_ids[j]
        i, j = i[other], j[other]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            linked = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            x, y = x[linked], y[linked]
            counts += np.bincount(x, weights=copies[y], minlength=len(a)).astype(np.int64)
            pairs.append((x, y))
    return counts, pairs


def links_in_classes(reps: DataFrame, classes: DataFrame, dimension: int, threshold: float = THRESHOLD, group: int = GROUP, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """counts (rep, n: linked vectors of other reps) and links (a, b) that connect all that link; both in several rows a rep.

    reps are rep, copies, x; classes node and component.
    """
    codes = Codes(dimension, 1, 0, seed)
    held = staged(classes.join(reps, classes.node == reps.rep).select("component", "rep", "copies", "x"), "classes")
    sizes = held.groupBy("component").agg(F.count("*").alias("n"))
    small = held.join(sizes.where(f"n <= {group}").select("component"), "component")
    result = "rep long, n long, least long"

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, pairs = exact_links(pdf, pdf, codes, threshold)
        ids = pdf["rep"].to_numpy()
        return pd.DataFrame({"rep": ids, "n": counts, "least": least_connected(len(ids), pairs, ids)})

    found = small.groupBy("component").applyInPandas(within, result)
    large = sizes.where(f"n > {group}").select("component")
    if large.isEmpty():
        found = staged(found, "links")
    else:
        found = staged(found.unionByName(_links_in_large(held.join(large, "component"), codes, threshold, group)), "links")
    return found.groupBy("rep").agg(F.sum("n").alias("n")), found.where("rep <> least").selectExpr("rep a", "least b")


def _links_in_large(held: DataFrame, codes: Codes, threshold: float, group: int) -> DataFrame:
    """links_in_classes for classes of over group vectors: rep, n, least."""
    d = codes.d

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_numpy()
            x = _doubles(batch.column(1).to_pylist()) if len(names) else np.empty((0, d))
            for c in np.unique(names):
                sums[int(c)] = sums.get(int(c), 0) + x[names == c].sum(axis=0)
        if sums:  # as many as there are large classes, each of over group vectors
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), _packed_bytes(np.array(list(sums.values()), "<f8"))], ["component", "x"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _doubles(pdf["x"]).sum(axis=0)
        return pd.DataFrame({"component": pdf["component"][:1], "centre": [(total / max(1e-300, math.sqrt(total @ total))).astype("<f8").tobytes()]})

    # A row for each task and large class meets in merge().
    centres = staged(held.select("component", "x").mapInArrow(add, "component long, x binary").groupBy("component").applyInPandas(merge, "component long, centre binary"), "centres")
    near = math.cos(math.acos(threshold) / 2) + CORE_SLACK

    @F.pandas_udf("boolean")
    def in_core(x: pd.Series, centre: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", _doubles(x), _doubles(centre)) >= near)

    marked = staged(held.join(centres, "component").select("component", "rep", "copies", "x", in_core("x", "centre").alias("core")), "marked")
    cores = marked.where("core").groupBy("component").agg(F.sum("copies").alias("all"), F.min("rep").alias("first"))
    by_number = marked.where("core").join(cores, "component").selectExpr("rep", "all - copies n", "first least")
    outer = marked.where("NOT core")
    parts = marked.groupBy("component").agg(F.ceil(F.count("*") / group).cast("long").alias("parts"), F.ceil(F.count(F.expr("CASE WHEN NOT core THEN 1 END")) / group).cast("long").alias("chunks")).where("chunks > 0")
    dealt = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    p = marked.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("rep"), "parts")).withColumn("chunk", dealt("chunks")).drop("parts", "chunks")
    q = outer.join(parts, "component").withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks")).withColumn("part", dealt("parts")).drop("parts", "chunks")

    def between(key, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rep": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "least": pd.Series(dtype="int64")})
        if not len(q) or not len(p):
            return none
        counts, pairs = exact_links(q, p, codes, threshold)
        i, j = (np.concatenate([x[k] for x in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
        # A vector of the core counts the outer ones that it links to; outer ones count for themselves.
        core = p["core"].to_numpy()
        back = np.bincount(j, weights=q["copies"].to_numpy()[i], minlength=len(p)).astype(np.int64)
        q_ids, p_ids = q["rep"].to_numpy(), p["rep"].to_numpy()
        ids = np.unique(np.concatenate([q_ids, p_ids]))
        least = least_connected(len(ids), [(np.searchsorted(ids, q_ids[i]), np.searchsorted(ids, p_ids[j]))], ids)
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, np.searchsorted(ids, q_ids), counts)
        np.add.at(n, np.searchsorted(ids, p_ids[core]), back[core])
        told = (n > 0) | (least != ids)
        return pd.DataFrame({"rep": ids[told], "n": n[told], "least": least[told]})

    block = ("component", "chunk", "part")
    q, p = q.toDF(*q.columns), p.toDF(*p.columns)  # columns of their own: both come from the same table
    met = q.groupBy(*block).cogroup(p.groupBy(*block)).applyInPandas(between, "rep long, n long, least long")
    return by_number.unionByName(met)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", miss: float = MISS, crowd: int = CROWD, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vec_id (and for each row without one).

    n_links counts the other vec_ids whose cosine is at least the threshold, component_id is the smallest vec_id that
    links reach, kept says that it is the row's own. Vectors that are null, zero or hold null or non-finite components
    link with nothing and are kept. A vec_id on several rows counts once, with the least valid vector of its rows. A row
    without a vec_id names no vector: no links, no component, kept is null. All valid vectors must have one dimension.
    An empty table gives an empty result; extra columns are ignored. No link below the threshold is made; a pair at the
    threshold that no third vector joins is missed with a chance of `miss`, nearer pairs with a much smaller one.
    """
    spark = vectors.sparkSession
    ship(spark)
    members, reps = classes_of_copies(vectors, vec_id, vector)
    facts = reps.agg(F.count("*"), F.max(F.length("x"))).first()
    ids = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"))
    everyone = ids.where("vec_id is not null").distinct().unionByName(ids.where("vec_id is null"))
    if not facts[0]:
        return everyone.selectExpr("vec_id", "0L n_links", "vec_id component_id", "CASE WHEN vec_id IS NOT NULL THEN true END kept")
    dimension = facts[1] // 8
    classes = candidate_classes(reps, dimension, facts[0], threshold, miss, crowd, group, seed)
    counts, links = links_in_classes(reps, classes, dimension, threshold, group, seed)
    components = connected_components(links)
    of_rep = reps.select("rep", "copies").join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    of_rep = of_rep.select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = members.join(of_rep, "rep").select(F.col("vec_id").alias("_v"), "n_links", "component_id")
    rows = everyone.join(found, F.col("vec_id") == F.col("_v"), "left")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
