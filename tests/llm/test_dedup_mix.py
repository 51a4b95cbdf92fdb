"""SimHash near-duplicates and mixing against brute force."""

from collections import defaultdict

import re

import xxhash

from ledgerloom.llm import queries
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.mixing import mix, mixed
from ledgerloom.llm.simhash import BITS, covering_masks, keep_one, near_duplicates

from .conftest import SF, counted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    named = {f for (i, _), f in zip(rows, fps) if i is not None}
    for a in named:
        for b in named:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    least = defaultdict(list)
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root(f)].append(i)
    return [(i, f"{f:016x}", min(least[root(f)], default=None)) for (i, _), f in zip(rows, fps)]


def test_near_duplicates_equal_brute_force(spark, texts):
    assert counted(queries.op1_simhash(spark, SF).collect()) == counted(brute(texts))


def test_near_duplicates_of_odd_rows(odd, odd_texts, none):
    assert counted(near_duplicates(odd).collect()) == counted(brute(odd_texts))
    assert near_duplicates(none).count() == 0


def test_covering_masks_leave_out_every_pair_of_bits():
    masks = covering_masks(2)
    assert len(masks) == 15 and min(m.bit_count() for m in masks) >= 42
    for a in range(BITS):
        for b in range(a, BITS):
            assert any(not m & (1 << a | 1 << b) for m in masks)


def test_one_document_of_each_group_stays(odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 7, 8, 9, 10, 11, 12]
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["no id here"]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
        left = 1.5 * sum(sizes.values()) - sum(2.0 * sizes[s] for s in names if s not in open_)
    return target


def check_mix(rows, want):
    assert counted((r.doc_id, r.size) for r in rows) == counted((i, len(WORD.findall(t or ""))) for i, t, _ in want)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in want:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert t - 1.001 <= taken[s] <= t + 1e-6


def test_mixing_meets_its_targets(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = mixed(docs).collect()
    check_mix(first, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    again = mixed(docs.repartition(5), carry=False)
    assert counted((r.doc_id, r.taken) for r in first) == counted((r.doc_id, r.taken) for r in again.collect())
    check_mix(mixed(odd).collect(), [(r.doc_id, r.text, r.source) for r in odd.collect()])
    assert mixed(none).count() == 0
    assert queries.op3_mixing(spark, SF).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]


def test_mixed_texts_hold_the_words_taken(odd):
    out = mix(odd)
    assert out.columns == odd.columns
    words = sum(len(WORD.findall(r.text or "")) for r in out.collect())
    assert words == sum(r.taken for r in mixed(odd).collect())


def test_a_cut_inside_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000, "a", "en", 800_000), (2, "w", "b", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    assert sum(len(r.text.split()) for r in mix(docs).where("source = 'a'").collect()) == sum(r.taken for r in mixed(docs).where("source = 'a'").collect())
