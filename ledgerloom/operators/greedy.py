"""The greedy of consolidate.assign() straight from linked lines, so that no pair is written.

Pairs keep to one amount and direction and to WINDOW days, and are taken by confidence, then by day. So the lines of an
amount and direction go by in the order of their days: a day's pairs of the first confidence are taken once the lines of
its window are there, those of the next once the first has passed that window, and so on. A task holds the lines of
these days (WINDOW for each confidence and for the pairs) of one amount and direction, whose pairs are made in blocks.
"""

from __future__ import annotations

import zlib
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fields import WINDOW
from ledgerloom.operators.consolidate import HOUR, HOUR_APART, HOUR_NEAR, HOUR_PERSON, NAME, NAME_PERSON, ONE_DOCUMENT, SAME_DOCUMENT
from ledgerloom.operators.storage import ship

#: Confidences of pairs that may become events, best first.
LEVELS = sorted({SAME_DOCUMENT, ONE_DOCUMENT, HOUR_PERSON, NAME_PERSON, HOUR, NAME}, reverse=True)
#: Pairs of lines compared at once, and pairs of a day that are kept from one confidence to the next; more are made again.
BLOCK, HELD = 1 << 20, 1 << 20
PIX, FULL, OTHER = 1, 2, 3
CODED = ("arquivo_id", "conta_id", "cpf", "cnpj", "nome")
PLAIN = ("id", "dia", "dia_mes", "papel", "minutos", "doc_dia", "doc_minutos", "pf", "pj", "unico")
AT = {c: k for k, c in enumerate(PLAIN + CODED)}
LATEST = 1 << 40


def _fits(t: str, y: str) -> bool:
    return y == t or (len(t) == 1 and y.startswith(t))


def _covers(short: list[str], long: list[str]) -> bool:
    left = list(long)
    for t in short:
        at = next((k for k, y in enumerate(left) if _fits(t, y)), None)
        if at is None:
            return False
        del left[at]
    return True


def names_agree(x: str, y: str) -> bool:
    """documents.names_agree() for two normalised names."""
    if len(x) <= 3 or len(y) <= 3:
        return False
    if x in y or y in x:
        return True
    tx, ty = x.split(" "), y.split(" ")
    return (len(tx) <= len(ty) and _covers(tx, ty)) or (len(tx) >= len(ty) and _covers(ty, tx))


def _masks(name: str) -> tuple[int, int, int]:
    """Bits of a name's pairs of characters, of the words and initials it needs, and of those it has."""
    bits = lambda found: reduce(or_, found, 0)
    word, first = lambda t: 1 << zlib.crc32(t.encode()) % 31, lambda t: 1 << 31 + zlib.crc32(t[:1].encode()) % 31
    tokens = name.split(" ")
    grams = bits(1 << zlib.crc32(name[k : k + 2].encode()) % 62 for k in range(len(name) - 1))
    return grams, bits(first(t) if len(t) == 1 else word(t) for t in tokens), bits(word(t) | first(t) for t in tokens)


class _Scope:
    """The lines of one amount and direction, whose days come in order."""

    def __init__(self):
        self.codes: dict[str, dict] = {c: {} for c in CODED}
        self.names: list[str] = []
        self.masks = np.empty((0, 3), np.int64)
        self.agreed: dict[tuple[int, int], bool] = {}
        self.days: dict[int, list[np.ndarray]] = {}
        self.pairs: dict[int, list | None] = {}
        self.done = [-LATEST] * len(LEVELS)
        self.used: set[int] = set()

    def add(self, batch: pa.RecordBatch) -> list[tuple]:
        """Takes in lines, and gives the pairs that are decided with them."""
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in PLAIN]
        for c in CODED:
            found = batch.column(c).dictionary_encode()
            seen = self.codes[c]
            codes = np.array([seen.setdefault(v, len(seen)) for v in found.dictionary.to_pylist()] + [-1], np.int64)
            columns.append(codes[found.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)])
        fresh = list(self.codes["nome"])[len(self.names) :]
        if fresh:
            self.names += fresh
            self.masks = np.concatenate([self.masks, np.array([_masks(n) for n in fresh], np.int64)])
        lines = np.stack(columns, axis=1).astype(np.int64, copy=False)
        out: list[tuple] = []
        for part in np.split(lines, np.flatnonzero(np.diff(lines[:, AT["dia"]])) + 1):
            day = int(part[0, AT["dia"]])
            if day not in self.days:
                out += self.advance(day - 1)
            self.days.setdefault(day, []).append(part)
        return out

    def advance(self, until: int) -> list[tuple]:
        """The pairs that can be taken when all lines up to a day are there."""
        out: list[tuple] = []
        for k in range(len(LEVELS)):
            ready = until - WINDOW
            for day in [d for d in self.days if self.done[k] < d <= ready]:
                out += self.take(day, k)
            until = self.done[k] = max(self.done[k], ready)
        for day in [d for d in self.days if d <= self.done[-1]]:
            self.used.difference_update(np.concatenate(self.days.pop(day))[:, AT["id"]].tolist())
            self.pairs.pop(day, None)
        return out

    def take(self, day: int, k: int) -> list[tuple]:
        if day not in self.pairs:
            held, n = [], 0
            for chunk in self.made(day):
                n += len(chunk[0])
                if n > HELD:
                    held = None
                    break
                held.append(chunk)
            self.pairs[day] = held
        out, used = [], self.used
        held = self.pairs[day]
        for a, b, level in self.made(day) if held is None else held:
            at = level == k
            for x, y in zip(a[at].tolist(), b[at].tolist()):
                if x not in used and y not in used:
                    used.update((x, y))
                    out.append((x, y, day, LEVELS[k]))
        return out

    def agree(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the names of two columns of codes agree: a matrix."""
        if not self.names:
            return np.zeros((len(x), len(y)), bool)
        (ux, ix), (uy, iy) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
        within = lambda p, q: (p & ~q) == 0
        (gx, nx, hx), (gy, ny, hy) = (self.masks[u].T for u in (ux, uy))
        may = within(gx[:, None], gy) | within(gy, gx[:, None]) | within(nx[:, None], hy) | within(ny, hx[:, None])
        may &= (ux >= 0)[:, None] & (uy >= 0)
        if len(self.agreed) > 1 << 20:
            self.agreed.clear()
        for i, j in zip(*(z.tolist() for z in np.nonzero(may))):
            pair = int(ux[i]), int(uy[j])
            if pair not in self.agreed:
                self.agreed[pair] = names_agree(self.names[pair[0]], self.names[pair[1]])
            may[i, j] = self.agreed[pair]
        return may[ix][:, iy]

    def made(self, day: int):
        """A day's pairs that may become events, those of a line together, in the order of ids: a_id, b_id and which of LEVELS."""
        first = np.concatenate(self.days[day])
        later = [p for d in range(day + 1, day + WINDOW + 1) for p in self.days.get(d, ())]
        other = np.concatenate([first, *(p[p[:, AT["papel"]] == FULL] for p in later)])
        if len(other) < 2:
            return
        first, other = first[np.argsort(first[:, 0], kind="stable")], other[np.argsort(other[:, 0], kind="stable")]
        y = {c: other[:, k] for c, k in AT.items()}
        for start in range(0, len(first), step := max(1, BLOCK // len(other))):
            rows = first[start : start + step]
            x = {c: rows[:, k, None] for c, k in AT.items()}
            both = (x["papel"] > 0) & (y["papel"] > 0) | (x["papel"] == OTHER) | (y["papel"] == OTHER)
            ok = np.where(y["dia"] == day, (y["id"] > x["id"]) & both, x["papel"] == PIX) & (x["arquivo_id"] != y["arquivo_id"])
            ok &= (x["conta_id"] == y["conta_id"]) | (x["conta_id"] < 0) | (y["conta_id"] < 0)
            ok &= (np.abs(x["minutos"] - y["minutos"]) <= HOUR_APART) | (x["minutos"] < 0) | (y["minutos"] < 0)
            if not ok.any():
                continue
            same = (x["cpf"] == y["cpf"]) & (x["cpf"] >= 0) | (x["cnpj"] == y["cnpj"]) & (x["cnpj"] >= 0)
            on_time = lambda p, c: (p["papel"] == PIX) & (c["papel"] == FULL) & (c["doc_dia"] == p["dia_mes"]) & (p["minutos"] >= 0) & (np.abs(c["doc_minutos"] - p["minutos"]) <= HOUR_NEAR)
            hour = on_time(x, y) | on_time(y, x)
            ok &= same | hour | self.agree(rows[:, AT["nome"]], y["nome"])
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            p, q = {c: rows[i, k] for c, k in AT.items()}, {c: other[j, k] for c, k in AT.items()}
            known = (np.where(q["cpf"] >= 0, q["pf"], p["pf"]) | np.where(q["cnpj"] >= 0, q["pj"], p["pj"])) > 0
            of_pix = np.where(p["papel"] == PIX, p["unico"], q["unico"]) > 0
            at_hour = np.where(known | of_pix, LEVELS.index(HOUR_PERSON), LEVELS.index(HOUR))
            by_name = np.where(known, LEVELS.index(ONE_DOCUMENT), np.where((p["unico"] | q["unico"]) > 0, LEVELS.index(NAME_PERSON), LEVELS.index(NAME)))
            yield p["id"], q["id"], np.where(same[i, j], LEVELS.index(SAME_DOCUMENT), np.where(hour[i, j], at_hour, by_name)).astype(np.int8)


def assign_lines(lines: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """a_id, b_id, a_data_movimento and confianca of the pairs that assign() takes of the main_pairs() of linked() lines.

    Lines are told apart by id. scope names further columns that must be equal, as in candidate_pairs(). The names and
    documents of an amount and direction are held as codes while its lines go by. Disk grows with the lines; the
    comparisons grow with the pairs of lines of an amount, direction and window, as the pairs themselves do.
    """
    spark = lines.sparkSession
    ship(spark)
    keys = ["valor", "direcao", *scope]
    role = F.when(F.col("papel") == "PIX", PIX).when(F.col("papel") == "COMPLETO", FULL).when(F.col("papel").isNotNull(), OTHER).otherwise(0)
    plain = {
        "id": F.col("id"), "dia": F.unix_date("data_movimento"), "dia_mes": F.dayofmonth("data_movimento"), "papel": role, "minutos": F.coalesce("minutos", F.lit(-1)), "doc_dia": F.coalesce("dia_hora.day", F.lit(-1)),
        "doc_minutos": F.coalesce("dia_hora.minutes", F.lit(-1)), "pf": F.col("pf").isNotNull(), "pj": F.col("pj").isNotNull(), "unico": F.col("unico").isNotNull(),
    }
    told = reduce(or_, [F.col(c).isNotNull() for c in ("cpf", "cnpj", "nome", "minutos", "dia_hora")])
    known = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in ("id", *keys, "data_movimento", "arquivo_id")])
    of_scope = F.concat_ws("\x01", *[F.col(k).cast("string") for k in keys]).alias("_scope")
    narrow = lines.where(known & told).select(of_scope, *[plain[c].cast("long").alias(c) for c in PLAIN], *[F.col(c).cast("string").alias(c) for c in CODED])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def decided(batches):
        held, key = None, None
        for batch in batches:
            out: list[tuple] = []
            found = batch.column(0).dictionary_encode()
            codes, values = found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
            for a, b in zip(starts, starts[1:]):
                if held is None or values[codes[a]] != key:
                    out += held.advance(LATEST) if held else []
                    held, key = _Scope(), values[codes[a]]
                out += held.add(batch.slice(a, b - a))
            yield packed(out)
        yield packed(held.advance(LATEST) if held else [])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64())], ["a_id", "b_id", "dia", "confianca"])

    taken = narrow.repartition(n, "_scope").sortWithinPartitions("_scope", "dia", "id").mapInArrow(decided, "a_id long, b_id long, dia int, confianca double")
    return taken.select("a_id", "b_id", F.date_from_unix_date("dia").alias("a_data_movimento"), "confianca")
