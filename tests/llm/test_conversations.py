"""Conversation repair against all edit sequences and against a plain walk over the rows."""

import collections
import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq

from ledgerloom.llm import conversations as c
from ledgerloom.llm import queries

LARGER = "/root/testdata/sf0.01"
LEGAL = re.compile("(s?(ua)+)?")


def every_repair(kinds, most=13, inserts=2):
    """The least (cost, audit) among all edit sequences of at most so many insertions."""
    found, n = [], len(kinds) // 2

    def go(k, cost, audit, out, left):
        if cost > most:
            return
        if k == n and LEGAL.fullmatch(out):
            found.append((cost, audit))
        if left:
            for r in "ua":
                go(k, cost + 3, audit + "I", out + r, left - 1)
        if k < n:
            initial, fault = kinds[2 * k : 2 * k + 2]
            go(k + 1, cost + 4, audit + "D", out, left)
            if fault != "d":
                extra = 3 if fault == "t" else 0
                go(k + 1, cost + extra, audit + "K", out + initial, left)
                for r in "ua":
                    go(k + 1, cost + 3 + extra, audit + "R", out + r, left)

    go(0, 0, "", "", inserts)
    return min(found, default=None)


def test_the_parse_is_the_cheapest_of_all_repairs():
    rng, compared = random.Random(3), 0
    for _ in range(300):
        kinds = "".join(rng.choice("suaxuaua") + rng.choice("----td") for _ in range(rng.randint(0, 5)))
        want = every_repair(kinds)
        if want:
            compared += 1
            assert c.parse(kinds) == want
        for cut in range(0, len(kinds) + 1, 2):
            assert c._best(c.joined(c._charts(kinds[:cut]), c._charts(kinds[cut:]))) == c.parse(kinds)
    assert compared > 200


def spaced(v):
    return " " if v is None else str(v)


def damage(rows):
    out = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        kept = out[conv_id]
        k = zlib.crc32(f"{spaced(conv_id)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if k == 4 else spaced(role), "" if k == 1 else spaced(text)
        text = re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows):
    """What the query gives for one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds, faults = set(), [], collections.Counter()
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        kinds.append((role[:1], {"blank": "d", "duplicate": "d", "truncated": "t", None: "-"}[fault]))
    # Cheapest way to each of: nothing yet, after s, after u, after a.
    best = {0: (0, "", ())}

    def put(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def insert(to):
        for _ in range(4):
            for state, (cost, audit, out) in list(to.items()):
                put(to, 3 if state == 2 else 2, (cost + 3, audit + "I", (*out, "assistant:" if state == 2 else "user:")))

    insert(best)
    for (initial, fault), (_, role, text) in zip(kinds, rows):
        now, extra = {}, 3 if fault == "t" else 0
        for state, (cost, audit, out) in best.items():
            put(now, state, (cost + 4, audit + "D", out))
            if fault != "d":
                if state == 0 and initial == "s":
                    put(now, 1, (cost + extra, audit + "K", (*out, f"{role}:{text}")))
                to, letter, name = (3, "a", "assistant") if state == 2 else (2, "u", "user")
                if initial == letter:
                    put(now, to, (cost + extra, audit + "K", (*out, f"{role}:{text}")))
                put(now, to, (cost + 3 + extra, audit + "R", (*out, f"{name}:{text}")))
        insert(now)
        best = now
    cost, audit, out = min(best[s] for s in (0, 3) if s in best)
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), list(out)


def held(found):
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(out) == len(found)
    return out


def test_conversations_equal_the_rule(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{LARGER}/conversations.parquet").to_pylist()]
    assert held(queries.op12_conversations(spark, LARGER).collect()) == {k: plain(v)[0] for k, v in damage(rows).items()}


def many(rng, conv_id, n):
    texts = ["Yes.", "No", "", " \n", "Why? ", "So it is!", "a"]
    return [(conv_id, rng.choice([None, *range(n)]), rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice([*texts, None, f"{rng.random()}."])) for _ in range(n)]


ODD = "conv_id long, turn long, role string, text string, fault string, _at int"


def odd_rows():
    rng = random.Random(9)
    rows = [r for conv_id in range(60) for r in many(rng, conv_id, rng.randint(1, 9))]
    rows += many(rng, None, 12) + many(rng, 1000, 700) + [(2000, 0, "user", "Same.")] * 300 + [(3000, 0, "system", "x" * 200_000 + ".")]
    return rows


def test_odd_conversations_and_one_over_many_tasks(spark):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, "f", 1) for r in rows], ODD)
    want = {k: plain(v) for k, v in damage(rows).items()}
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that partitions are not joined again
    try:
        damaged = c.damaged(table)
        assert held(c.repair_findings(table, damaged).collect()) == {k: v[0] for k, v in want.items()}
        ordered = c.in_order(damaged)
        assert c.runs_of(ordered).where("conv_id = 1000").count() > 1
        got = collections.defaultdict(list)
        for r in sorted(c.repaired_conversations(damaged).collect(), key=lambda r: r.position):
            assert r.position == len(got[r.conv_id]) and r.edit in "KRI"
            got[r.conv_id].append(f"{r.role}:{r.text}")
        assert dict(got) == {k: v[1] for k, v in want.items() if v[1]}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_long_runs_are_finished_in_a_second_pass(spark, monkeypatch):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, "f", 1) for r in rows], ODD).coalesce(1)
    found = c.runs_of(c.in_order(c.damaged(table)).coalesce(1)).where("conv_id = 3000").first()
    assert found.n == len(damage(rows)[3000])
    want = {k: plain(v)[0] for k, v in damage(rows).items()}
    ordered = c.in_order(c.damaged(table))
    runs = c.runs_of(ordered)
    monkeypatch.setattr(c, "runs_of", lambda _: runs.withColumn("repaired_sha256", c.F.lit(None).cast("string")))
    assert held(c.findings(ordered).collect()) == {k: v for k, v in want.items() if v[6]}


def test_no_conversations(spark):
    table = spark.createDataFrame([], ODD)
    assert c.repair_findings(table, c.damaged(table)).count() == 0 and c.repaired_conversations(table).count() == 0
