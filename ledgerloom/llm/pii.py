"""Personal data by weak supervision (operator 5), in DataFrame functions only.

Patterns propose candidate spans. Three labelers vote on each: the strict form (checks included), a gazetteer of known
prefixes, endings and ranges, and cue words before the span. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is for each kind; the posteriors are soft labels that train a final classifier
over votes and shape. Spans that the strict forms of email, ip, card and phone give always stay; the classifier adds
others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import staged, text_of

#: Kinds in the order of results; the first four have strict forms that always stay.
KINDS = ("email", "ip", "card", "phone", "national_id", "secret")
BASE_KINDS = 4
#: Stands at both ends of a match while a text is cut up; where a text has it already, NOT_MARK takes its place meanwhile.
MARK, NOT_MARK = "\ue000", "\ue001"

# The strict patterns, written so that no position is scanned twice and no loop recurses: possessive loops, and a start
# that is never inside a run that has just failed. They match the same spans as
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
# (card also looks ahead for the 13 digits without which its length check drops a run).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wider patterns, whose spans only the classifier can add.
WIDE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"
WIDE_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?i)\b(?:token|secret|api[_-]?key|access[_-]?key|passwd|password)\b[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?[A-Za-z0-9_/+-]{12,}+[\"']?"

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_OK = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
# What the gazetteer knows.
KNOWN = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|ch|at|be|pt|br|mx|eu|us|ca|au|jp|in)$",
    "ip": r"^(?!0|10\.|127\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38|62)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})[^0-9]*|\(?[2-9])",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "secret": r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])",
}
# Cue words shortly before a span.
CUES = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write to|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|adresse)",
    "card": r"(?i)(?:card|visa|master|amex|credit|kreditkarte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|whatsapp|handy|anruf|t[eé]l)",
    "national_id": r"(?i)(?:ssn|social security|tax id|national id)",
    "secret": r"(?i)(?:token|secret|key|passw)",
}
#: Characters before a span in which a cue counts.
REACH = 40
#: Characters of a block of a text that is being redacted.
PIECE = 1000
ROUNDS = 20
ONE = "struct<kind:int,start:int,stop:int,base:boolean,strict:int,known:int,cue:int,shape:string>"
SPAN = f"array<{ONE}>"
FEATURES = ("strict", "known", "cue", "shape")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value taken once: a name in an expression stands for all of it, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under join (sum or greatest), by doubling: n log n steps in all."""
    steps = F.expr("transform(sequence(0, 29), k -> shiftleft(1, k))")
    return F.aggregate(F.filter(steps, lambda k: k < F.size(values)), values, lambda v, k: F.transform(v, lambda x, i: F.when(i < k, x).otherwise(join(x, F.get(v, i - k)))))


def _matches(t: Column, pattern: str) -> Column:
    """Array of (start, stop, m, before) of all matches, leftmost first, in code points."""
    parts = F.split(F.regexp_replace(t, pattern, f"{MARK}$0{MARK}"), MARK)

    def placed(p: Column) -> Column:
        def hits(ends: Column) -> Column:
            at = F.transform(p, lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("stop"), x.alias("m"), F.right(F.get(p, i - 1), F.lit(REACH)).alias("before")))
            return F.filter(at, lambda x, i: i % 2 == 1)

        return _let(_running(F.transform(p, F.length), lambda a, b: a + b), hits)

    return _let(parts, placed)


def _luhn(m: Column) -> Column:
    def holds(digits: Column) -> Column:
        n = F.length(digits)

        def add(a: Column, k: Column) -> Column:
            d = F.substring(digits, n - k + 1, F.lit(1)).cast("int")
            return a + F.when(k % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

        return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))

    return _let(F.regexp_replace(m, "[^0-9]", ""), holds)


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _candidates(t: Column, kind: str, pattern: str, gate: Column, strict: Callable[[Column], Column] | None, wide: Callable[[Column], Column]) -> Column:
    """Spans of one pattern: those whose strict check holds are base, and of the others those that wide lets pass."""
    empty = F.array().cast(SPAN)

    def span(x: Column) -> Column:
        m = x["m"]
        base = strict(m) if strict else F.lit(False)
        alone = F.when(x["before"].rlike(r"[A-Za-z0-9]$"), "w").when(x["before"] == "", "s").otherwise("b")
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            x["start"].alias("start"),
            x["stop"].alias("stop"),
            base.alias("base"),
            (base if strict else F.lit(True)).cast("int").alias("strict"),
            m.rlike(KNOWN[kind]).cast("int").alias("known"),
            (x["before"].rlike(CUES[kind]) if kind != "secret" else m.rlike(CUES[kind])).cast("int").alias("cue"),
            F.concat(alone, F.least(F.lit(9), F.floor(F.length(m) / 4)).cast("string")).alias("shape"),
        )

    found = F.transform(F.filter(_matches(t, pattern), lambda x: wide(x["m"])), span)
    return F.when(gate, found.cast(SPAN)).otherwise(empty)


def candidate_spans(text: Column) -> Column:
    """All candidates of a text, in any order."""
    t = F.translate(text, MARK, NOT_MARK)
    digit, yes = t.rlike("[0-9]"), lambda m: F.lit(True)
    each = [
        _candidates(t, "email", EMAIL, t.contains("@"), yes, yes),
        _candidates(t, "ip", IP, t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(IP_OK), lambda m: m.rlike(IP_OK)),
        _candidates(t, "card", CARD, t.rlike(r"[0-9][\x20-]?[0-9]"), _luhn, lambda m: _digits(m).between(13, 19)),
        _candidates(t, "phone", PHONE, t.contains("+"), lambda m: _digits(m).between(9, 15), lambda m: _digits(m).between(9, 15)),
        _candidates(t, "email", WIDE_EMAIL, t.rlike(r"[\[(](?:at|AT)[\])]"), None, yes),
        _candidates(t, "phone", WIDE_PHONE, digit, None, yes),
        _candidates(t, "national_id", NATIONAL_ID, digit & t.contains("-"), None, yes),
        _candidates(t, "secret", SECRET, t.rlike("(?i)token|secret|key|passw"), None, yes),
    ]
    return F.concat(*each)


def _posterior(p: str, x: str) -> str:
    """SQL of the probability that a candidate with votes x is personal data, by parameters p."""
    yes = " * ".join([f"{p}.prior"] + [f"(CASE WHEN {x}.{v} = 1 THEN {p}.yes_{v} ELSE 1 - {p}.yes_{v} END)" for v in FEATURES[:3]])
    no = " * ".join([f"(1 - {p}.prior)"] + [f"(CASE WHEN {x}.{v} = 1 THEN {p}.no_{v} ELSE 1 - {p}.no_{v} END)" for v in FEATURES[:3]])
    return f"(({yes}) / (({yes}) + ({no})))"


def estimate_reliability(patterns: DataFrame) -> DataFrame:
    """EM over counts of vote patterns (kind, strict, known, cue, n): adds the posterior of each pattern.

    A kind has at most 8 patterns, so its EM is one expression over a small array. Pseudo-counts keep every
    probability off 0 and 1: a labeler is taken to be right in 8 of 10 cases and to fire wrongly in 1 of 10.
    """
    x, s = "x", "s"
    post = _posterior(s, x)
    total = "aggregate(v, 0D, (t, x) -> t + x.n)"
    hits = f"aggregate(v, 0D, (t, x) -> t + x.n * {post})"
    step = [f"({hits} + 1) / ({total} + 2) AS prior"]
    for f in FEATURES[:3]:
        step.append(f"(aggregate(v, 0D, (t, x) -> t + x.n * x.{f} * {post}) + 8) / ({hits} + 10) AS yes_{f}")
        step.append(f"(aggregate(v, 0D, (t, x) -> t + x.n * x.{f} * (1 - {post})) + 1) / ({total} - {hits} + 10) AS no_{f}")
    start = ["0.5D AS prior"] + [y for f in FEATURES[:3] for y in (f"0.8D AS yes_{f}", f"0.1D AS no_{f}")]
    em = f"aggregate(sequence(1, {ROUNDS}), struct({', '.join(start)}), (s, i) -> struct({', '.join(step)}))"
    grouped = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("strict", "known", "cue", F.col("n").cast("double").alias("n")))).alias("v"))
    learned = grouped.withColumn("p", F.expr(em))
    return learned.selectExpr("kind", "p", "inline(v)").withColumn("one", F.struct("strict", "known", "cue")).selectExpr("kind", "strict", "known", "cue", f"{_posterior('p', 'one')} AS posterior")


def train(spans: DataFrame) -> dict[str, float]:
    """Weights of the span classifier (log-odds by kind, feature and value), from candidates of all documents.

    The counts are grouped over all spans; what reaches the driver is one row for each kind, feature and value: at most
    6 x (3 x 2 + 30) rows and 6 priors, whatever the input.
    """
    counts = staged(spans.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")), "votes")
    posterior = estimate_reliability(counts.groupBy("kind", *FEATURES[:3]).agg(F.sum("n").alias("n")))
    soft = counts.join(posterior, ["kind", *FEATURES[:3]]).select("kind", *FEATURES, (F.col("n") * F.col("posterior")).alias("yes"), (F.col("n") * (1 - F.col("posterior"))).alias("no"))
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in FEATURES])
    cells = soft.select("kind", "yes", "no", F.inline(each)).groupBy("kind", "feature", "value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    priors = soft.groupBy("kind").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    weight = F.log((F.col("yes") + 1) / (F.col("all_yes") + 10)) - F.log((F.col("no") + 1) / (F.col("all_no") + 10))
    rows = cells.join(priors, "kind").select(F.concat_ws(":", "kind", "feature", "value").alias("k"), weight.alias("w"))
    rows = rows.union(priors.select(F.concat_ws(":", "kind", F.lit("prior"), F.lit("")), F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1))))
    return {r["k"]: r["w"] for r in rows.collect()}


def _clear(spans: Column, others: Column) -> Column:
    """Those of others that overlap no base span of spans.

    Base spans stand by their starts, others by their stops, in one sorted array; the farthest base stop so far then
    tells whether a span that begins before another's stop reaches past its start.
    """
    base = F.transform(F.filter(spans, lambda x: x["base"]), lambda x: F.struct(x["start"].alias("place"), F.lit(1).alias("turn"), x["stop"].alias("reach"), F.lit(None).cast(ONE).alias("span")))
    rest = F.transform(others, lambda x: F.struct(x["stop"].alias("place"), F.lit(0).alias("turn"), F.lit(-1).alias("reach"), x.alias("span")))

    def free(line: Column) -> Column:
        reach = _running(F.transform(line, lambda x: x["reach"]), F.greatest)
        held = _let(reach, lambda r: F.filter(line, lambda x, i: x["span"].isNotNull() & (F.get(r, i) <= x["span"]["start"])))
        return F.transform(held, lambda x: x["span"])

    return F.when(F.size(others) == 0, others).otherwise(_let(F.array_sort(F.concat(base, rest)), free))


def accepted(spans: Column, weights: dict[str, float]) -> Column:
    """The base spans and those others that the classifier takes and that overlap no base span; by kind, then start."""
    if not weights:
        return F.array_sort(F.filter(spans, lambda x: x["base"]))
    table = F.create_map(*[F.lit(v) for k, w in sorted(weights.items()) for v in (k, float(w))])

    def weight(x: Column, feature: str, value: Column) -> Column:
        return F.coalesce(F.try_element_at(table, F.concat_ws(":", x["kind"].cast("string"), F.lit(feature), value)), F.lit(0.0))

    def likely(x: Column) -> Column:
        score = weight(x, "prior", F.lit(""))
        for f in FEATURES:
            score = score + weight(x, f, x[f].cast("string"))
        return ~x["base"] & (score > 0)

    return F.array_sort(F.concat(F.filter(spans, lambda x: x["base"]), _let(F.filter(spans, likely), lambda o: _clear(spans, o))))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and spans (array of kind, start, stop, base and votes, by kind and start): one row for each row of docs.

    Texts are read once; their candidates are kept in the shared folder without the texts. Null texts count as empty
    and have no spans; null doc_ids and repeated rows are returned as they are. An empty table gives an empty result.
    """
    found = staged(docs.select(F.col(doc_id).cast("long").alias("doc_id"), candidate_spans(text_of(text)).alias("c")), "spans")
    weights = train(found.select(F.inline("c")))
    return found.select("doc_id", accepted(F.col("c"), weights).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_personal_data(); starts and ends in code points, ends exclusive."""
    base = F.filter("spans", lambda x: x["base"])
    d = found.withColumn("b", base)
    counts = [F.expr(f"CAST(size(filter(b, x -> x.kind = {k})) AS BIGINT) AS n_{KINDS[k]}") for k in range(BASE_KINDS)]
    return d.select("doc_id", *counts, F.sha2(listed(F.col("b")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("found"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets, and n_chars set anew where there is such a column.

    Overlapping spans become one, named for the first. Null texts stay null; extra columns of any name are carried along;
    repeated rows and null ids stay as they are, and an empty table gives an empty result.
    """
    # Written without the texts: training reads the candidates twice, and finding them is what costs.
    weights = train(staged(docs.select(candidate_spans(text_of(text)).alias("c")), "spans").select(F.inline("c")))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("t"), candidate_spans(text_of(text)).alias("c"))
    d = d.select("row", F.when(F.size("c") == 0, F.col("t")).otherwise(replaced(F.col("t"), accepted(F.col("c"), weights))).alias("new"))
    out = [F.col("new").alias(text) if c == text else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return d.select(*out)


def replaced(t: Column, spans: Column) -> Column:
    """A text with its spans replaced by their kinds in angle brackets; overlapping spans are one, named for the first.

    Each span that begins at or past the farthest stop before it opens a stretch; the text between stretches stays.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def pieces(both: Column) -> Column:
        line, blocks = both["line"], both["blocks"]

        def between(start: Column, stop: Column) -> Column:
            """Of a long text only the blocks from start to stop are read; finding a place in the whole text starts at its front."""
            first = F.floor(start / PIECE).cast("int")
            held = F.array_join(F.slice(blocks, first + 1, F.floor(stop / PIECE).cast("int") - first + 1), "")
            return F.substring(held, start - first * PIECE + 1, stop - start)

        def told(reach: Column) -> Column:
            opens = F.filter(F.transform(line, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("past"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["past"])
            said = F.transform(opens, lambda x: F.concat(between(x["past"], x["start"]), F.get(names, x["kind"])))
            return F.concat(F.array_join(said, ""), between(F.element_at(reach, -1), F.length(t)))

        return _let(_running(F.transform(line, lambda x: x["stop"]), F.greatest), told)

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(ordered) == 0, t).otherwise(_let(F.struct(ordered.alias("line"), blocks.alias("blocks")), pieces))
