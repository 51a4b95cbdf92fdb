"""Every license rule is tried on whatever it matches."""

import itertools
import re
from re import _constants as C
from re import _parser

from ledgerloom.llm.licenses import ANCHORS, FAMILIES, FORMS, STATEMENTS, scan


def expanded(tree):
    """Texts that take every alternative of a parsed expression; loops none or as few times as they can, and once."""
    parts = []
    for op, value in tree:
        if op is C.LITERAL:
            parts.append([chr(value)])
        elif op is C.IN:
            parts.append([chr(v) if o is C.LITERAL else "x" if o is C.CATEGORY else chr(v[0]) for o, v in value])
        elif op is C.BRANCH:
            parts.append([t for branch in value[1] for t in expanded(branch)])
        elif op is C.SUBPATTERN:
            parts.append(expanded(value[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            parts.append([t * n for n in sorted({least, min(most, max(least, 1))}) for t in expanded(inner)])
        else:
            raise ValueError(op)
    return ["".join(p) for p in itertools.product(*parts)]


def texts_of(expression):
    found = expanded(_parser.parse(expression))
    assert all(re.fullmatch(expression, t) for t in found)
    return found


def test_every_alternative_holds_a_keyword():
    named = [(name, words) for _, name, words in FAMILIES] + [(e, words) for _, _, _, e, words in STATEMENTS]
    for expression, words in named:
        for t in texts_of(expression):
            assert any(w in t for w in words.split(",")), (expression, t)


def test_every_form_holds_an_anchor():
    for expression in [form.format(n="name") for _, _, form in FORMS] + [s[3] for s in STATEMENTS]:
        for t in texts_of(expression):
            assert any(a in t for a in ANCHORS), (expression, t)


def test_expat_is_found():
    for t in ("Licensed under the Expat license", "the expat license", "subject to the Expat licence"):
        assert "mit" not in t.lower() and "mit" in scan(t)[5].split(",")


def test_the_surest_finding_of_a_label_counts_in_any_order():
    a, b = "Licensed under the MIT License.", "license mit"
    scores = [scan(t)[6] for t in (f"{a} {b}", f"{b} {a}", a, b)]
    assert scores[0] == scores[1] == max(scores[2:]) > min(scores[2:])
