"""Conversation structure repair by error-correcting Earley parsing (operator 12).

A weighted grammar of roles says what a conversation is; productions that delete a row, give it another role or insert
one cost extra. The parser's chart items hold the least (cost, audit) of their derivations, audits being compared as
text, and the completed chart yields the repair.

Roles follow `(s?(ua)+)?`. The grammar is left-recursive, so that every item starts at column 0 and a column has a
bounded number of items whatever the conversation's length:

    Start  -> empty | Start delete          System -> Start s | System delete
    User   -> Start u | System u | Assistant u | User delete
    Assistant -> User a | Assistant delete        goals: Start, Assistant
    u, a -> keep | rerole | insert          s -> keep

Two audits of the same rows and the same cost are never one the beginning of the other (all but the insertions stand for
a row, and an insertion costs), so the least (cost, audit) of a stretch stays least whatever is put before or after it.
Hence stretches can be parsed apart, from every nonterminal to every other, and joined like matrices: a conversation
with very many rows is parsed where its rows lie, after a range sort, and only the stretches' charts meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import ship, staged

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NONTERMINALS = ("Start", "System", "User", "Assistant")
GOALS = ("Start", "Assistant")
#: Productions X -> Y terminal, by Y: what may follow a completed Y.
AFTER = {"Start": (("System", "s"), ("User", "u")), "System": (("User", "u"),), "User": (("Assistant", "a"),), "Assistant": (("User", "u"),)}
ROLE = {"u": "user", "a": "assistant"}
#: Rows that are parsed as one stretch; longer runs are joined from such stretches.
STRETCH = 64
#: Marks that end a text.
ENDS = r"[.!?]"

Chart = dict[str, tuple[int, str]]


def parse_stretch(rows: str, entry: str) -> Chart:
    """The completed nonterminals after the rows, with their least (cost, audit), for a chart that begins with entry.

    rows has two letters for each row: the role's initial (`s`, `u`, `a`, else `x`) and its fault (`-`, `t` or `d`).
    """
    column: Chart = {entry: (0, "")}

    def complete(chart: Chart, name: str, cost: int, audit: str, agenda: list[str]) -> None:
        if name not in chart or (cost, audit) < chart[name]:
            chart[name] = (cost, audit)
            agenda.append(name)

    def predict(chart: Chart) -> None:
        """Adds what follows by insertions, until no item gets better."""
        agenda = list(chart)
        while agenda:
            cost, audit = chart[name := agenda.pop()]
            for to, terminal in AFTER[name]:
                if terminal in ROLE:
                    complete(chart, to, cost + INSERT, audit + "I", agenda)

    predict(column)
    for k in range(0, len(rows), 2):
        initial, fault = rows[k], rows[k + 1]
        following: Chart = {}
        extra = TRUNCATED if fault == "t" else 0
        for name, (cost, audit) in column.items():
            complete(following, name, cost + DELETE, audit + "D", [])
            if fault != "d":
                for to, terminal in AFTER[name]:
                    if initial == terminal:
                        complete(following, to, cost + extra, audit + "K", [])
                    elif terminal in ROLE:
                        complete(following, to, cost + REROLE + extra, audit + "R", [])
        predict(following)
        column = following
    return column


@lru_cache(maxsize=1 << 14)
def _charts(rows: str) -> dict[str, Chart]:
    return {entry: parse_stretch(rows, entry) for entry in NONTERMINALS}


def joined(left: dict[str, Chart], right: dict[str, Chart]) -> dict[str, Chart]:
    """The charts of two stretches in a row, from every entry."""
    out: dict[str, Chart] = {}
    for entry, chart in left.items():
        best: Chart = {}
        for middle, (cost, audit) in chart.items():
            for to, (more, rest) in right[middle].items():
                found = (cost + more, audit + rest)
                if to not in best or found < best[to]:
                    best[to] = found
        out[entry] = best
    return out


def joined_all(charts: list[dict[str, Chart]]) -> dict[str, Chart]:
    """joined() over a list, by halves, so that an audit is copied log n times only."""
    charts = charts or [_charts("")]
    while len(charts) > 1:
        charts = [joined(*charts[k : k + 2]) if k + 1 < len(charts) else charts[k] for k in range(0, len(charts), 2)]
    return charts[0]


def charts_of(rows: str) -> dict[str, Chart]:
    """The charts of rows of any number."""
    return joined_all([_charts(rows[k : k + 2 * STRETCH]) for k in range(0, len(rows), 2 * STRETCH)])


def parse(rows: str) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    chart = charts_of(rows)["Start"]
    return min(chart[goal] for goal in GOALS if goal in chart)


def given_role(position: int, total: int) -> str:
    """The role that a reroled or inserted row gets at a position (from 0) of a repaired conversation of so many rows.

    (ua)+ has an even number of rows, so an odd total says that a system row stands first.
    """
    return ROLE["ua"[(position - total % 2) % 2]]


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text after a repeatable damage: by crc32 of `conv_id:turn` modulo 20 (nulls: one space)
    0 drops the row, 1 empties the text, 2 takes its end marks, 3 repeats the row, 4 makes it the user's."""
    text_of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    d = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"),
        (F.crc32(F.concat(text_of(conv_id), F.lit(":"), text_of(turn)).cast("binary")) % 20).alias("_k"),
    ).where("_k <> 0")
    d = d.withColumn("role", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")))
    d = d.withColumn("text", F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", ENDS, "")).otherwise(F.col("text")))
    return d.withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k", "_copy")


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, _at: the rows of all conversations in one order, written as a table.

    Within a conversation rows go by turn (nulls first), then by role and text, which makes the order whole up to rows
    that are equal. fault is the row's first: blank, duplicate (role and text stand on an earlier row), truncated, or
    null. Rows are sorted by range, so that one conversation may lie in any number of partitions; _at counts up through
    each partition's rows and from one partition to the next.
    """
    rows = staged(rows.select("conv_id", "turn", "role", "text").withColumn("_id", F.monotonically_increasing_id()), "rows")
    key = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    place = F.struct(F.col("turn").isNotNull().alias("a"), "turn", "_id")
    first = rows.select("conv_id", key.alias("key"), place.alias("place")).groupBy("conv_id", "key").agg(F.min("place").alias("place")).select(F.col("place._id").alias("_id"), F.lit(True).alias("_first"))
    rows = rows.join(first, "_id", "left")
    solid = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = F.when(solid == "", "blank").when(F.col("_first").isNull(), "duplicate").when(~F.substring(solid, -1, 1).rlike(ENDS), "truncated")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_id")]
    rows = rows.withColumn("fault", fault).repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(rows.select("conv_id", "turn", "role", "text", "fault").withColumn("_at", F.monotonically_increasing_id()), "conversations")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LEGAL = {"su", "ua", "au"}
_RUN = (
    "conv_id {id}, first_at long, last_at long, n long, first_role string, last_role string, blank long, duplicate long, truncated long, "
    "illegal long, lowest long, highest long, turns long, first_turn long, last_turn long, charts binary, cost long, audit string, repaired_sha256 string"
)


def _kind(initial: str, fault: str | None) -> str:
    return (initial if initial in ("s", "u", "a") else "x") + ("-" if fault is None else "t" if fault == "truncated" else "d")


def _best(charts: dict[str, Chart]) -> tuple[int, str]:
    return min(charts["Start"][goal] for goal in GOALS if goal in charts["Start"])


def _packed(charts: dict[str, Chart]) -> bytes:
    return "\n".join(f"{a} {b} {cost} {audit}" for a, chart in charts.items() for b, (cost, audit) in chart.items()).encode()


def _unpacked(raw: bytes) -> dict[str, Chart]:
    out: dict[str, Chart] = {n: {} for n in NONTERMINALS}
    for line in raw.decode().split("\n"):
        a, b, cost, audit = line.split(" ")
        out[a][b] = (int(cost), audit)
    return out


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "surrogatepass")


def repaired(edits: str, rows: Iterable[tuple[str, str]], position: int = 0, total: int | None = None) -> Iterator[tuple[str, str]]:
    """role and text of the rows that the edits leave, the first of them at a position of the repaired conversation."""
    own, total = iter(rows), len(edits) - edits.count("D") if total is None else total
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(own)
        if edit != "D":
            yield (role if edit == "K" else given_role(position, total)), text
            position += 1


class _Run:
    """Rows of one conversation that follow each other, read one by one.

    Only their kinds are held, and texts while the run is short; a longer run's digest is made in a second pass.
    """

    SHORT_ROWS, SHORT_TEXT = 4096, 1 << 22

    def __init__(self, conv_id, at: int):
        self.conv_id, self.first_at, self.last_at = conv_id, at, at - 1
        self.kinds: list[str] = []
        self.lines: list[tuple[str, str]] | None = []
        self.held, self.illegal, self.turns = 0, 0, 0
        self.initial = self.lowest = self.turn = None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, at: int, turn: int | None, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        if self.initial is None:
            self.first_role, self.first_turn = initial, turn
        elif self.initial + initial not in _LEGAL:
            self.illegal += 1
        if turn is not None:
            self.turns += self.turn != turn
            self.lowest, self.turn = turn if self.lowest is None else self.lowest, turn
        if fault:
            self.faults[fault] += 1
        self.kinds.append(_kind(initial, fault))
        self.initial, self.last_at, self.last_turn = initial, at, turn
        if self.lines is not None:
            self.lines.append((role, text))
            self.held += len(text)
            if len(self.lines) > self.SHORT_ROWS or self.held > self.SHORT_TEXT:
                self.lines = None

    def record(self) -> tuple:
        charts, sha = charts_of("".join(self.kinds)), None
        cost, audit = _best(charts)
        if self.lines is not None:
            sha = hashlib.sha256(b"\n".join(_line(role, text) for role, text in repaired(audit, self.lines))).hexdigest()
        f = self.faults
        return (
            self.conv_id, self.first_at, self.last_at, len(self.kinds), self.first_role, self.initial, f["blank"], f["duplicate"], f["truncated"],
            self.illegal, self.lowest, self.turn, self.turns, self.first_turn, self.last_turn, _packed(charts), cost, audit, sha,
        )


def _batch(rows: list[tuple], fields: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    """rows as a batch; fields as in a DDL string, the first of the type of conv_id."""
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    names, kinds = zip(*(f.split(" ") for f in fields))
    return pa.RecordBatch.from_arrays([pa.array(c, id_type if k == 0 else types[kinds[k]]) for k, c in enumerate(zip(*rows))], list(names))


def runs_of(rows: DataFrame) -> DataFrame:
    """A row for each run of rows of one conversation that lie together in a task: faults, charts, digest if it is short.

    rows is a result of in_order(). A conversation has at most one run for each partition and file split it lies in.
    """
    ship(rows.sparkSession)
    schema = _RUN.format(id=rows.schema["conv_id"].dataType.simpleString())
    fields = schema.split(", ")

    def read(batches):
        run, found, id_type = None, [], None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv_id, turn, role, text, fault, at in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if run is None or conv_id != run.conv_id or at != run.last_at + 1:
                    if run is not None:
                        found.append(run.record())
                    run = _Run(conv_id, at)
                run.add(at, turn, role, text, fault)
            if len(found) > 1000:
                yield _batch(found, fields, id_type)
                found = []
        if run is not None:
            yield _batch([*found, run.record()], fields, id_type)

    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "fault", "_at").mapInArrow(read, schema)


_WHOLE = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, ways array<struct<first_at:long,last_at:long,edits:string,position:long,total:long>>"


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs of one conversation as one, and the edits that fall to each."""
    records = pdf.sort_values("first_at").to_dict("records")
    cost, audit = _best(joined_all([_unpacked(r["charts"]) for r in records]))
    total = len(audit) - audit.count("D")
    illegal = turns = position = start = 0
    previous, ways = None, []
    for k, r in enumerate(records):
        illegal += int(r["illegal"]) + (previous is not None and previous["last_role"] + r["first_role"] not in _LEGAL)
        turns += int(r["turns"]) - (previous is not None and previous["last_turn"] == r["first_turn"])  # a null turn equals none
        previous = r
        # The letters of this run's rows and the insertions before each of them; the last run has those at the end too.
        stop, left = start, int(r["n"])
        while stop < len(audit) and (left or k + 1 == len(records)):
            left -= audit[stop] != "I"
            stop += 1
        edits = audit[start:stop]
        ways.append({"first_at": int(r["first_at"]), "last_at": int(r["last_at"]), "edits": edits, "position": position, "total": total})
        position, start = position + len(edits) - edits.count("D"), stop
    low, high = pdf["lowest"].min(), pdf["highest"].max()
    counts = {f: [int(pdf[f].sum())] for f in ("blank", "duplicate", "truncated")}
    gaps = 0 if pd.isna(low) else int(high) - int(low) + 1 - turns
    return pd.DataFrame({"conv_id": [records[0]["conv_id"]], "gaps": [gaps], **counts, "illegal": [illegal], "cost": [cost], "audit": [audit], "ways": [ways]})


def _gathered(runs: DataFrame) -> DataFrame:
    whole = _WHOLE.format(id=runs.schema["conv_id"].dataType.simpleString())
    return staged(runs.groupBy("conv_id").applyInPandas(_gather, whole), "gathered")


def _laid(rows: DataFrame, gathered: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text: what the edits make of the rows, run by run.

    A run's edits come before its rows, dealt and sorted with them, and are used up as the rows stream by.
    """
    ship(rows.sparkSession)
    ways = gathered.select(F.col("conv_id").alias("_c"), F.explode("ways").alias("w")).select("_c", "w.*")
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    lines = rows.join(ways.select("_c", "first_at", "last_at"), same & F.col("_at").between(F.col("first_at"), F.col("last_at")))
    no = F.lit(None).cast("long")
    both = lines.select("conv_id", "first_at", "_at", no.alias("position"), no.alias("total"), "role", "text").unionByName(
        ways.select(F.col("_c").alias("conv_id"), "first_at", F.lit(-1).cast("long").alias("_at"), "position", "total", F.lit("").alias("role"), F.col("edits").alias("text"))
    )
    both = both.repartition("first_at").sortWithinPartitions("first_at", "_at")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position long, edit string, role string, text string"
    fields = schema.split(", ")

    def lay(batches):
        conv_id, edits, at, position, total, out, id_type = None, "", 0, 0, 0, [], None

        def take(role: str = "", text: str = ""):
            nonlocal at, position
            edit = edits[at]
            at += 1
            if edit != "D":
                out.append((conv_id, position, edit, role if edit == "K" else given_role(position, total), text))
                position += 1

        for batch in batches:
            id_type = batch.schema.field(0).type
            for own, _, place, start, of, role, text in zip(*(batch.column(k).to_pylist() for k in range(7))):
                while at < len(edits) and edits[at] == "I":
                    take()
                if place < 0:
                    conv_id, edits, at, position, total = own, text, 0, start, of
                else:
                    take(role, text)
            if out:
                yield _batch(out, fields, id_type)
                out = []
        while at < len(edits):
            take()
        if out:
            yield _batch(out, fields, id_type)

    return both.mapInArrow(lay, schema)


def _digests(laid: DataFrame) -> DataFrame:
    """_c (the conv_id) and repaired_sha256 of repaired rows; a task streams a conversation and holds a batch."""
    schema = f"_c {laid.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"

    def stream(batches):
        digest, conv, made, id_type = None, None, [], None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv_id, position, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not position:
                    if digest is not None:
                        made.append((conv, digest.hexdigest()))
                    conv, digest = conv_id, hashlib.sha256(_line(role, text))
                else:
                    digest.update(b"\n" + _line(role, text))
        if digest is not None:
            yield _batch([*made, (conv, digest.hexdigest())], schema.split(", "), id_type)

    return laid.select("conv_id", "position", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(stream, schema)


def findings(rows: DataFrame) -> DataFrame:
    """conv_id, COUNTS, audit and repaired_sha256 of every conversation that has rows; rows is a result of in_order().

    Conversations whose rows lie in one run are finished there. The others (fewer than there are tasks) have their runs'
    charts joined; their repaired rows are laid out run by run and then streamed through the digest, which can be taken
    in no other way than in order: one task reads such a conversation, a batch at a time.
    """
    runs = staged(runs_of(rows), "runs")
    unfinished = runs.groupBy("conv_id").agg(F.count("*").alias("n"), F.count("repaired_sha256").alias("done")).where("n > 1 or done = 0").select(F.col("conv_id").alias("_c"))
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    gaps = F.expr("coalesce(highest - lowest + 1 - turns, 0L) AS gaps")
    whole = runs.join(unfinished, same, "left_anti").select("conv_id", gaps, *COUNTS[1:], "audit", "repaired_sha256")
    if unfinished.isEmpty():
        return whole
    gathered = _gathered(runs.join(unfinished, same, "left_semi"))
    digests = _digests(_laid(rows, gathered))
    rest = gathered.join(digests, same, "left").select("conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
    return whole.unionByName(rest)


NOTHING = hashlib.sha256(b"").hexdigest()


def _filled(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return in_order(rows.select("conv_id", "turn", blank("role"), blank("text")))


def repair_findings(conversations: DataFrame, rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for every conv_id.

    rows (conv_id, turn, role, text) are the rows to repair; a conversation of `conversations` without any gets zeros,
    an empty audit and the digest of nothing. A null conv_id is a conversation like any other. Null turns come first
    and count in no gap; null roles and texts count as one space. Repeated rows are duplicates. A row whose role has
    another initial than s, u or a can only be reroled or deleted. Rows of one turn go by role and text. Texts of any
    length are read whole; empty tables give empty results; extra columns are ignored.
    """
    names = conversations.select(F.col(f"`{conv_id}`").alias("_c")).distinct()
    all_of = names.join(findings(_filled(rows)), F.col("_c").eqNullSafe(F.col("conv_id")), "left")
    return all_of.select(
        F.col("_c").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"),
    )


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text: the conversations after their cheapest repair.

    rows and odd values as in repair_findings(). A conversation of which nothing is left has no row. Long conversations
    are repaired run by run, in as many tasks as their rows lie in.
    """
    ordered = _filled(rows)
    return _laid(ordered, _gathered(runs_of(ordered)))
