"""License scans by ordered signature rules (operator 7).

Every rule is a regular expression over a text's words, joined by single spaces, with a priority and keywords. A
text needs an anchor word at all; one pass of an Aho-Corasick automaton then finds the keywords, and only rules with a
keyword in the text are tried. Of overlapping
detections, those inside an interval of a rule of higher priority (or of equal priority and greater length) go.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import ship

# Phrases of consecutive words that always count, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_V = r"(?: version| v)?"
# Each license's label, its name in words (a regular expression) and the keywords of which any mention holds one.
FAMILIES = (
    ("apache-2.0", rf"apache(?: software)?(?: licen[cs]e)?{_V} ?2(?: 0)?", "apache"),
    ("apache-1.1", rf"apache(?: software)?(?: licen[cs]e)?{_V} 1 1", "apache"),
    ("apache-1.0", rf"apache(?: software)?(?: licen[cs]e)?{_V} 1 0", "apache"),
    ("mit", r"(?:mit|expat)(?: x11)?", "mit,expat"),
    ("mit-0", r"mit(?: 0| no attribution)", "mit"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", "bsd"),
    ("gpl-1.0", rf"(?:gnu )?(?:gpl|general public licen[cs]e){_V} ?1(?: 0)?", "gpl,general public"),
    ("gpl-2.0", rf"(?:gnu )?(?:gpl|general public licen[cs]e){_V} ?2(?: 0)?", "gpl,general public"),
    ("gpl-3.0", rf"(?:gnu )?(?:gpl|general public licen[cs]e){_V} ?3(?: 0)?", "gpl,general public"),
    ("gpl", r"gnu (?:gpl|general public)", "gnu gpl,gnu general"),
    ("lgpl-2.0", rf"(?:gnu )?(?:lgpl|(?:library|lesser) general public licen[cs]e){_V} ?2(?: 0)?", "lgpl,lesser general,library general"),
    ("lgpl-2.1", rf"(?:gnu )?(?:lgpl|lesser general public licen[cs]e){_V} ?2 1", "lgpl,lesser general,library general"),
    ("lgpl-3.0", rf"(?:gnu )?(?:lgpl|lesser general public licen[cs]e){_V} ?3(?: 0)?", "lgpl,lesser general,library general"),
    ("lgpl", r"(?:gnu )?(?:lgpl|lesser general public)", "lgpl,lesser general,library general"),
    ("agpl-3.0", rf"(?:gnu )?(?:agpl|affero general public licen[cs]e){_V} ?3(?: 0)?", "agpl,affero"),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public)", "agpl,affero"),
    ("gfdl-1.2", rf"gnu free documentation licen[cs]e{_V} 1 2", "gfdl,free documentation"),
    ("gfdl-1.3", rf"gnu free documentation licen[cs]e{_V} 1 3", "gfdl,free documentation"),
    ("gfdl", r"(?:gfdl|gnu free documentation)", "gfdl,free documentation"),
    ("mpl-1.1", rf"(?:mpl|mozilla public licen[cs]e){_V} ?1 1", "mpl,mozilla"),
    ("mpl-2.0", rf"(?:mpl|mozilla public licen[cs]e){_V} ?2(?: 0)?", "mpl,mozilla"),
    ("epl-1.0", rf"(?:epl|eclipse public licen[cs]e){_V} ?1(?: 0)?", "epl,eclipse"),
    ("epl-2.0", rf"(?:epl|eclipse public licen[cs]e){_V} ?2(?: 0)?", "epl,eclipse"),
    ("cddl-1.0", rf"(?:cddl|common development and distribution licen[cs]e){_V}(?: 1 0)?", "cddl,common development"),
    ("eupl-1.2", rf"(?:eupl|european union public licen[cs]e){_V}(?: 1 [12])?", "eupl,european union"),
    ("artistic-1.0", rf"artistic(?: licen[cs]e)?{_V} 1 0", "artistic"),
    ("artistic-2.0", rf"artistic(?: licen[cs]e)?{_V} 2(?: 0)?", "artistic"),
    ("isc", r"isc", "isc"),
    ("zlib", r"zlib(?: libpng)?", "zlib"),
    ("boost-1.0", rf"boost(?: software)?(?: licen[cs]e)?{_V}(?: 1 0)?", "boost"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "wtfpl,do what the"),
    ("cc0-1.0", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "cc0,cc zero,creative commons zero"),
    ("cc-by-4.0", r"(?:cc by|creative commons attribution) 4 0", "cc by,creative commons attribution"),
    ("cc-by-3.0", r"(?:cc by|creative commons attribution) 3 0", "cc by,creative commons attribution"),
    ("cc-by-2.0", r"(?:cc by|creative commons attribution) 2 [05]", "cc by,creative commons attribution"),
    ("cc-by-sa-4.0", r"(?:cc by sa|creative commons attribution share ?alike) 4 0", "cc by sa,creative commons attribution share"),
    ("cc-by-sa-3.0", r"(?:cc by sa|creative commons attribution share ?alike) 3 0", "cc by sa,creative commons attribution share"),
    ("cc-by-nc-4.0", r"(?:cc by nc|creative commons attribution non ?commercial) 4 0", "cc by nc,creative commons attribution non"),
    ("cc-by-nc-3.0", r"(?:cc by nc|creative commons attribution non ?commercial) 3 0", "cc by nc,creative commons attribution non"),
    ("cc-by-nd-4.0", r"(?:cc by nd|creative commons attribution no ?deriv\w*) 4 0", "cc by nd,creative commons attribution no"),
    ("cc-by-nc-sa-4.0", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0", "cc by nc sa,creative commons attribution non"),
    ("cc-by-nc-nd-4.0", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w*) 4 0", "cc by nc nd,creative commons attribution non"),
    ("odbl-1.0", r"(?:odbl|open database)(?: licen[cs]e)?(?: 1 0)?", "odbl,open database"),
    ("ofl-1.1", r"(?:sil open font|ofl)(?: licen[cs]e)?(?: 1 1)?", "ofl,open font"),
    ("postgresql", r"postgresql", "postgresql"),
    ("python-2.0", r"(?:python software foundation|psf)(?: licen[cs]e)?(?: 2(?: 0)?)?", "psf,python software"),
    ("openssl", r"openssl", "openssl"),
    ("public-domain", r"public domain", "public domain"),
)
# The ways in which a text states its license, with the rule's priority and weight; {n} is a name.
FORMS = (
    (50, 0.98, r"spdx license identifier {n}(?: only| or later)?"),
    (40, 0.95, r"(?:licen[cs]ed|released|distributed|published|provided|available|placed|dedicated)(?: \w+){{0,3}}? (?:under|in|into|to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{n}(?: licen[cs]e)?(?: only| or later| or any later version)?"),
    (30, 0.85, r"(?:subject to|governed by|terms of|conditions of|compliance with) (?:the )?{n}(?: licen[cs]e)?"),
    (20, 0.75, r"(?:the )?{n} (?:international |unported |generic )?(?:public )?licen[cs]e"),
    (10, 0.60, r"licen[cs]e(?: is)? (?:the )?{n}"),
)
# Statements that name no license. Priority, weight, label, expression, keyword.
STATEMENTS = (
    (15, 0.70, "reserved", r"all rights (?:are )?reserved", "reserved"),
    (15, 0.70, "proprietary", r"(?:proprietary and confidential|confidential and proprietary|unauthorized (?:copying|reproduction|distribution|use)(?: \w+){0,8} prohibited)", "proprietary,confidential,unauthorized"),
    (15, 0.70, "permissive", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is"),
    (15, 0.70, "permissive", r"permission to use copy modify and or distribute this software for any purpose", "permission to"),
    (15, 0.70, "permissive", r"redistribution and use in source and binary forms(?: with or without modification)?", "redistribution"),
    (15, 0.60, "no-warranty", r"(?:provided|distributed) (?:by \w+(?: \w+){0,5} )?(?:on an )?as is(?: basis)? without (?:any )?warrant(?:y|ies)", "as is"),
    (5, 0.40, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright"),
    (5, 0.40, "cc", r"(?:some rights reserved|creative commons)", "some rights,creative commons"),
)
#: A mention needs one of these somewhere; texts without any run no rule.
ANCHORS = ("licen", "spdx", "released", "distributed", "published", "provided", "available", "placed", "dedicated", "subject to", "governed by", "terms of", "conditions of", "compliance with", "rights", "permission", "redistribution", "copyright", "confidential", "unauthorized", "creative commons", "as is")


_ANCHORS = tuple(a.encode() for a in ANCHORS)


class Rule(NamedTuple):
    priority: int
    weight: float
    label: str
    expression: re.Pattern
    keywords: tuple[str, ...]


class Detection(NamedTuple):
    start: int
    stop: int
    priority: int
    weight: float
    label: str


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, first priority first: every family in every form, then the statements."""
    found = [Rule(p, w, label, re.compile(rf"(?<!\S)(?:{form.format(n=name)})(?!\S)"), tuple(words.split(","))) for p, w, form in FORMS for label, name, words in FAMILIES]
    found += [Rule(p, w, label, re.compile(rf"(?<!\S)(?:{e})(?!\S)"), tuple(words.split(","))) for p, w, label, e, words in STATEMENTS]
    return tuple(sorted(found, key=lambda r: (-r.priority, r.label)))


@lru_cache(maxsize=1)
def _keywords() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in {word for r in rules() for word in r.keywords}:
        a.add_word(word, word)
    a.make_automaton()
    return a


def detect(words: str) -> list[Detection]:
    """What the rules find in a text's joined words, without what a better detection holds; by place."""
    here = {word for _, word in _keywords().iter(words)}
    hits = [
        Detection(m.start(), m.end(), r.priority, r.weight, r.label)
        for r in rules()
        if not here.isdisjoint(r.keywords)
        for m in r.expression.finditer(words)
    ]
    return outermost(hits)


def outermost(hits: list[Detection]) -> list[Detection]:
    """The detections that lie in no better one, by place. Better: higher priority, or equal and longer.

    Better ones come first; a Fenwick tree holds, for each start, the farthest stop of those that begin there or
    before, so n detections take n log n steps.
    """
    places = {start: k for k, start in enumerate(sorted({d.start for d in hits}), 1)}
    farthest, kept = [0] * (len(places) + 1), []
    rank = lambda d: (-d.priority, d.start - d.stop)
    for _, equals in groupby(sorted(hits, key=rank), key=rank):
        clear = []
        for d in equals:
            k, stop = places[d.start], 0
            while k:
                stop, k = max(stop, farthest[k]), k & (k - 1)
            if stop < d.stop:
                clear.append(d)
        for d in clear:
            k = places[d.start]
            while k < len(farthest):
                farthest[k] = max(farthest[k], d.stop)
                k += k & -k
        kept += clear
    return sorted(kept)


_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and detections of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()
    joined = b" ".join(words)
    padded, places, base = b" " + joined + b" ", [], set()
    for phrase, label in BASE.items():
        needle, seen, word = f" {phrase} ".encode(), 0, 0
        at = padded.find(needle)
        while at >= 0:
            word, seen = word + padded.count(b" ", seen, at), at
            places.append(word)
            base.add(label)
            at = padded.find(needle, at + 1)
    found = detect(joined.decode("utf-8", "surrogatepass")) if any(a in joined for a in _ANCHORS) else []
    doubt = 0.2 if base else 1.0
    best: dict[str, float] = {}
    for d in found:  # of a label's findings the surest counts, wherever it stands
        best[d.label] = max(d.weight, best.get(d.label, 0.0))
    for weight in best.values():
        doubt *= 1 - weight
    labels = base.union(d.label for d in found)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt if labels else 0.0, found


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", detections: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, counts and labels, and with detections what the rules found.

    n_base counts the places of the base phrases; first_word and last_word are their least and greatest start in words,
    null where there is none. labels holds the base labels and the rules' labels. score is the chance that at least one
    finding is right, if each label's largest weight is its own: 0 without findings. detections: start and stop (in characters
    of the joined words), label, priority. Null texts count as empty; null doc_ids and repeated rows are returned as
    they are; rows are independent, so nothing is shuffled.
    """
    ship(docs.sparkSession)
    kinds = [("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double")]
    nested = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string()), ("priority", pa.int32())]))

    def run(batches):
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind, _) in enumerate(kinds)]
            names = ["doc_id", *(k[0] for k in kinds)]
            if detections:
                columns.append(pa.array([[{"start": d.start, "stop": d.stop, "label": d.label, "priority": d.priority} for d in r[-1]] for r in rows], nested))
                names.append("detections")
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = "doc_id long, " + ", ".join(f"{n} {s}" for n, _, s in kinds)
    if detections:
        schema += ", detections array<struct<start:int,stop:int,label:string,priority:int>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
