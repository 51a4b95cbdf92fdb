"""Personal data, licenses and quality rules against brute force."""

import hashlib
import re

import duckdb

from ledgerloom.llm import queries
from ledgerloom.llm.licenses import Detection, outermost, rules, scan_licenses
from ledgerloom.llm.pii import digest, find_personal_data, redact
from ledgerloom.llm.quality import judged, keep_good

from .conftest import SF, counted

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute_base(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if holds(k, m[0])]


def check_spans(rows, texts):
    want = []
    for i, t in texts:
        if t and len(t) > 100_000:  # the plain pattern backtracks over long runs
            want.append((i, None))
            continue
        base = brute_base(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, (*(sum(x[0] == k for x in base) for k in KINDS), hashlib.sha256(listed.encode()).hexdigest(), {f"{k}:{a}:{b}" for k, a, b in base})))
    got = sorted(rows, key=lambda r: (repr(r.doc_id), r.base_sha256))
    want = sorted(want, key=lambda r: (repr(r[0]), r[1][4] if r[1] else ""))
    assert len(got) == len(want)
    for r, (i, w) in zip(got, want):
        assert r.doc_id == i
        if w:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == w[:5]
            assert w[5] <= set(r.spans.split(","))  # base spans stay


def test_personal_data_equals_brute_force(spark, texts, odd, odd_texts, none):
    check_spans(queries.op5_pii(spark, SF).collect(), texts)
    check_spans(digest(find_personal_data(odd)).collect(), odd_texts)
    assert digest(find_personal_data(none)).count() == 0


def test_labelers_add_spans_and_leave_clean_texts(spark):
    rows = [(i, "write to bob [at] example [dot] org or call 555-010-1234; token: abcd1234efgh5678" if i % 2 else "in 2020 there were 12 of 40 towns with 3.5 mills") for i in range(200)]
    found = digest(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    for r in found:
        assert r.n_email == r.n_ip == r.n_card == r.n_phone == 0
        assert (r.spans != "") == bool(r.doc_id % 2)


def test_redaction_replaces_base_spans(odd, none):
    out = redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[7].startswith("mail <EMAIL> or b@ <EMAIL>, call <PHONE>, card <CARD>, ip 10.1.2.300 <IP>.5")
    assert text[3] is None and text[4] == "" and "<IP>" in text[8] and "" in text[8]
    assert redact(none).count() == 0


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_equal_brute_force(spark, texts, odd, odd_texts, none):
    for rows, want in ((queries.op7_licenses(spark, SF).collect(), texts), (scan_licenses(odd).collect(), odd_texts)):
        assert counted(r[:6] for r in rows) == counted((i, *brute_license(t)) for i, t in want)
        for r in rows:
            assert set(r.base_labels.split(",")) <= {"", *r.labels.split(",")} and 0 <= r.score <= 1
    assert scan_licenses(none).count() == 0


def test_license_rules_find_what_they_name(spark):
    said = {
        "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License)",
        "mit": "This is released under the MIT license.",
        "gpl-3.0": "distributed under the terms of the GNU General Public License version 3",
        "cc-by-sa-4.0": "available under the Creative Commons Attribution-ShareAlike 4.0 license",
        "bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
        "public-domain": "dedicated to the public domain",
    }
    rows = list(said.items()) + [("", "the apache helicopter flew over mit and the boost was great")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.labels.split(",") for r in scan_licenses(docs).collect()}
    for k, (label, _) in enumerate(rows):
        assert label in found[k], (label, found[k])
    assert found[len(rows) - 1] == [""] and len(rules()) > 200


def test_better_detections_hide_what_they_contain():
    a, b, c = Detection(0, 10, 5, 0.5, "a"), Detection(2, 8, 1, 0.5, "b"), Detection(8, 12, 1, 0.5, "c")
    assert outermost([b, c, a]) == [a, c]


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(repeated)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_quality_equals_brute_force(spark, texts, odd, odd_texts, none):
    for rows, want in ((queries.op10_quality(spark, SF).collect(), texts), (judged(odd).collect(), odd_texts)):
        got = counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
        assert got == counted((i, *brute_quality(t)) for i, t in want)
        assert not any(r.base_failed and r.kept for r in rows)
    assert judged(none).count() == 0


def test_quality_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.op10_quality(spark, SF)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.oracle_sql()['op10_quality']})").fetchall()
    assert counted(found.collect()) == counted(want)


def test_kept_documents_keep_their_columns(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in judged(docs).collect() if r.kept)
    assert keep_good(none).count() == 0


def test_noise_is_rejected_and_prose_kept(spark):
    words = "river stone garden letter morning window winter summer market bridge song horse house paper silver".split()
    prose = " ".join(words[k * k % 15] + (" of the" if k % 3 else ", and to") for k in range(97)) + "."
    noise = " ".join(f"#{k}$%{k * 7919}" for k in range(120))
    docs = spark.createDataFrame([(1, noise, "en"), (2, noise, None)], "doc_id long, text string, lang string")
    assert [r.kept for r in judged(docs).collect()] == [False, False]
    distance = judged(spark.createDataFrame([(1, prose, "en")], docs.schema)).first().class_distance
    assert distance < 0.17
