"""Language of web pages by Bayesian evidence fusion (operator 2).

Four kinds of evidence on a page meet: the likelihood of its text (byte trigrams), the language its markup declares, the
suffix of its address, and a prior of its host that is smoothed towards its domain's and that towards all pages'. How
far declarations and suffixes can be trusted, and all priors, are grouped sums of the text posteriors over all pages.
"""

from __future__ import annotations

import html as html_entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import ship, staged

LANGUAGES = ("de", "en", "es", "fr")
#: Labelled documents of each language that the text model is fitted on, at most: those of least hash.
SAMPLE = 300
BUCKETS = 1 << 16
#: Trigrams that a text counts for, at most: neighbouring ones aren't independent.
EFFECTIVE = 60
#: Pages that a domain's and a host's prior weigh in with against their own.
DOMAIN_WEIGHT, HOST_WEIGHT = 20.0, 5.0
#: Soft counts are whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
# Suffixes of countries with one main language among those known.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en"}

_OPEN = re.compile(r"<(script|style|nav|noscript|template)\b|<!--|<div class=\"ad\">", re.I)
_CLOSE = re.compile(r"</(script|style|nav|noscript|template)\s*+>|</div>", re.I)
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b([^>]*)", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def _without_dropped(page: str) -> str:
    """A page with a space for each script, style, navigation, template, comment and advertisement that is closed.

    Closing tags are found once, and each name's are used up in order, so the page is read forward only.
    """
    closing: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSE.finditer(page):
        closing.setdefault((m[1] or "div").lower(), []).append(m.span())
    used, out, at, after, comment = dict.fromkeys(closing, 0), [], 0, 0, 0
    while m := _OPEN.search(page, after):
        after, end = m.end(), -1
        if m[0] == "<!--":
            if comment >= 0:  # else no comment ends after here
                comment = page.find("-->", after)
                end = comment + 3 if comment >= 0 else -1
        else:
            name = (m[1] or "div").lower()
            spans, k = closing.get(name, ()), used.get(name, 0)
            while k < len(spans) and spans[k][0] < after:
                k += 1
            used[name] = k
            end = spans[k][1] if k < len(spans) else -1
        if end >= 0:
            out += (page[at : m.start()], " ")
            at = after = end
    return "".join((*out, page[at:]))


def page_text(page: str | None) -> str:
    """The text of a page without markup, scripts and navigation, in time that grows with its length."""
    bare = _without_dropped(page or "")
    last = bare.rfind(">") + 1  # a tag that isn't closed is text, and none is closed after here
    return html_entities.unescape(_TAG.sub(" ", bare[:last]) + bare[last:])


def declared_language(page: str | None) -> str:
    """The first language that an html tag names, wherever it stands; no character is read twice by the outer pattern."""
    for tag in _HTML.finditer(page or ""):
        if m := _LANG.search(tag[1]):
            return m[1].lower()
    return ""


def trigrams(text: str) -> np.ndarray:
    """Buckets of a text's byte trigrams, in lower case."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    return ((b[:-2] * np.uint32(2654435761)) ^ (b[1:-1] * np.uint32(40503) << np.uint32(8)) ^ (b[2:] * np.uint32(69069))) >> np.uint32(7) & np.uint32(BUCKETS - 1)


def fit_text_model(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> bytes:
    """Log probabilities (float32, languages x buckets) from at most sample labelled documents of each language."""
    ship(docs.sparkSession)
    key = F.xxhash64("doc_id")
    chosen = None
    for lang in languages:
        part = docs.where((F.col("lang") == lang) & F.col("text").isNotNull()).select("doc_id", key.alias("k")).orderBy("k", "doc_id").limit(sample).select("doc_id")
        chosen = part if chosen is None else chosen.union(part)
    ids = [r[0] for r in chosen.collect() if r[0] is not None]  # at most languages x sample ids
    texts = docs.where(F.col("doc_id").isin(ids)).select("lang", "text") if ids else docs.select("lang", "text").limit(0)

    def count(batches):
        counts = {lang: np.zeros(BUCKETS, np.int64) for lang in languages}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang in counts:
                    counts[lang] += np.bincount(trigrams(text.as_py() or ""), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])

    total = np.full((len(languages), BUCKETS), 0.1)
    # All tasks scan; the chosen texts alone go to 4 tasks, which give 4 x languages rows.
    for r in texts.repartition(4).mapInArrow(count, "lang string, counts binary").collect():
        total[languages.index(r["lang"])] += np.frombuffer(r["counts"], np.int64)
    return np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32).tobytes()


@lru_cache(maxsize=2)
def _matrix(model: bytes, n: int) -> np.ndarray:
    return np.frombuffer(model, np.float32).reshape(n, BUCKETS)


def _evidence(pages: DataFrame, model: bytes, languages: tuple[str, ...]) -> DataFrame:
    """Narrow rows: page_id, url, declared, and l0, l1, ... (tempered log likelihoods of the text)."""
    n = len(languages)
    held = pages.sparkSession.sparkContext.broadcast(model)  # languages x 256 KiB, whatever the input

    def run(batches):
        weights = _matrix(held.value, n)
        for batch in batches:
            declared, rows = [], []
            for page in batch.column(2):
                page = page.as_py()
                grams = trigrams(page_text(page))
                share = min(1.0, EFFECTIVE / max(1, len(grams)))
                rows.append([float(w[grams].sum(dtype=np.float64)) * share for w in weights])
                declared.append(declared_language(page))
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), *columns], ["page_id", "url", "declared", *(f"l{k}" for k in range(n))])

    schema = "page_id long, url string, declared string, " + ", ".join(f"l{k} double" for k in range(n))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)


def _normal(d: DataFrame, scores: list[Column], prefix: str) -> DataFrame:
    """Adds the softmax of scores as prefix0, prefix1, ..."""
    top = F.greatest(*scores)
    raw = [F.exp(s - top) for s in scores]
    total = sum(raw[1:], raw[0])
    return d.withColumns({f"{prefix}{k}": r / total for k, r in enumerate(raw)})


def identify(pages: DataFrame, labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> DataFrame:
    """page_id, lang, confidence, declared, host: one row for each row of pages.

    labelled has doc_id, text and lang. A page without text, declaration and telling address gets its host's prior; a
    null address has the host "" and the suffix none. Ties go to the first language in order. Null and repeated
    page_ids are returned as they are. Each page's own text is left out of its host's prior, so nothing counts twice.
    Rows are joined to their host's sums by host; a host with a third of all pages is one row there, and Spark splits
    its pages' partition.
    """
    n = len(languages)
    found = staged(_evidence(pages, fit_text_model(labelled, languages, sample), languages), "evidence")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    d = found.withColumn("host", host).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    d = d.withColumn("suffix", F.coalesce(F.try_element_at(known, F.regexp_extract("host", r"([^.]+)$", 1)), F.lit("none")))
    d = d.withColumn("said", F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise(F.when(F.col("declared") == "", "none").otherwise("other")))
    d = _normal(d, [F.col(f"l{k}") for k in range(n)], "p")
    d = d.withColumns({f"p{k}": F.round(F.col(f"p{k}") * UNIT).cast("long") for k in range(n)})
    sums = [F.sum(f"p{k}").alias(f"c{k}") for k in range(n)]
    hosts = staged(d.groupBy("host", "domain", "suffix").agg(*sums), "hosts")
    # Small tables: one row in all, one for each declaration, one for each suffix class.
    whole = hosts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(n)]).first()
    everything = [float(whole[k]) / UNIT for k in range(n)]
    share = [(c + 1) / (sum(everything) + n) for c in everything]

    def trust(rows: list, right: str) -> dict[str, list[float]]:
        """P(class | language), with pseudo-counts that take a class that names a language to be right mostly."""
        classes = [*languages, "none", "other"]
        prior = {c: [8.0 if c == lang else 2.0 if c == "none" else 0.5 for lang in languages] for c in classes}
        soft = {r[right]: [r[f"c{k}"] / UNIT for k in range(n)] for r in rows}
        both = {c: [prior[c][k] + soft.get(c, [0.0] * n)[k] for k in range(n)] for c in classes}
        return {c: [both[c][k] / sum(x[k] for x in both.values()) for k in range(n)] for c in classes}

    said = trust(d.groupBy("said").agg(*sums).collect(), "said")
    suffix = trust(hosts.groupBy("suffix").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(n)]).collect(), "suffix")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"c{k}").alias(f"d{k}") for k in range(n)])
    hosts = hosts.drop("suffix").join(domains, "domain").drop("domain")
    d = d.join(hosts, "host")

    def log_of(table: dict[str, list[float]], column: str, k: int) -> Column:
        out = F
        for c, values in table.items():
            out = out.when(F.col(column) == c, F.lit(float(np.log(values[k]))))
        return out.otherwise(F.lit(0.0))

    own = sum([F.col(f"p{k}") for k in range(1, n)], F.col("p0"))
    all_d = sum([F.col(f"d{k}") for k in range(1, n)], F.col("d0")) - own
    all_h = sum([F.col(f"c{k}") for k in range(1, n)], F.col("c0")) - own
    scores = []
    for k in range(n):
        of_domain = ((F.col(f"d{k}") - F.col(f"p{k}")) / UNIT + DOMAIN_WEIGHT * share[k]) / (all_d / UNIT + DOMAIN_WEIGHT)
        of_host = ((F.col(f"c{k}") - F.col(f"p{k}")) / UNIT + HOST_WEIGHT * of_domain) / (all_h / UNIT + HOST_WEIGHT)
        scores.append(F.col(f"l{k}") + F.log(of_host) + log_of(said, "said", k) + log_of(suffix, "suffix", k))
    d = _normal(d.withColumns({f"s{k}": s for k, s in enumerate(scores)}), [F.col(f"s{k}") for k in range(n)], "q")
    best = F.greatest(*[F.col(f"q{k}") for k in range(n)])
    lang = F.coalesce(*[F.when(F.col(f"q{k}") == best, languages[k]) for k in range(n)])
    return d.select("page_id", lang.alias("lang"), F.round(best, 6).alias("confidence"), "declared", "host")
