"""Column expressions over tax documents (CPF, CNPJ) and person names."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the ledger's writers use it, no-break spaces included.
BLANK = r"[\s   ﻿]+"
_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
CPF_IN_TEXT = rf"{_BEFORE}[0-9]{{3}}\.?[0-9]{{3}}\.?[0-9]{{3}}-?[0-9]{{2}}{_AFTER}"
CNPJ_IN_TEXT = rf"{_BEFORE}[A-Za-z0-9]{{2}}\.?[A-Za-z0-9]{{3}}\.?[A-Za-z0-9]{{3}}/?[A-Za-z0-9]{{4}}-?[0-9]{{2}}{_AFTER}"


def _accents() -> tuple[str, str]:
    """Latin letters with accents, and the plain letter of each."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _check_digit(d: Column, n: int) -> Column:
    """The check digit after the first n digits: weights n + 1 down to 2, modulo 11."""
    total = sum((F.substring(d, k + 1, 1).cast("int") * (n + 1 - k) for k in range(1, n)), F.substring(d, 1, 1).cast("int") * (n + 1))
    return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)


def _right_digits(d: Column) -> Column:
    """Whether 11 digits end in their check digits."""
    return (_check_digit(d, 9) == F.substring(d, 10, 1).cast("int")) & (_check_digit(d, 10) == F.substring(d, 11, 1).cast("int"))


def cpf_is_valid(c: Column) -> Column:
    """Whether a text holds a CPF: 11 digits, not all equal, with the right check digits. Null counts as invalid."""
    return F.coalesce(normalize_cpf(c).isNotNull(), F.lit(False))


def normalize_cpf(c: Column, strict: bool = True) -> Column:
    """The 11 digits, or null where they are no CPF; strict also tests the check digits."""
    shaped = lambda d: (F.length(d) == 11) & ~d.rlike(r"^(.)\1{10}$")
    return let(digits(c), lambda d: F.when(shaped(d), F.when(_right_digits(d), d) if strict else d))


def normalize_cnpj(c: Column) -> Column:
    """12 letters or digits and two digits, in capitals; null for anything else."""
    d = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return F.when(d.rlike("^[A-Z0-9]{12}[0-9]{2}$"), d)


def normalize_name(c: Column) -> Column:
    """Trimmed, in capitals, without accents (Latin letters and combining marks), white space collapsed."""
    plain = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")
    return F.upper(F.trim(F.regexp_replace(plain, BLANK, " ")))


def mask_document(c: Column) -> Column:
    """11 digits as a CPF is written, 14 characters as a CNPJ; anything else unchanged."""
    part = lambda a, n: F.substring(c, a, n)
    cpf = F.concat(part(1, 3), F.lit("."), part(4, 3), F.lit("."), part(7, 3), F.lit("-"), part(10, 2))
    cnpj = F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("/"), part(9, 4), F.lit("-"), part(13, 2))
    return F.when(F.length(c) == 11, cpf).when(F.length(c) == 14, cnpj).otherwise(c)


def cpf_in_text(c: Column) -> Column:
    """The first CPF-shaped text, or null."""
    return F.nullif(F.regexp_extract(c, CPF_IN_TEXT, 0), F.lit(""))


def documents_in_text(c: Column) -> Column:
    """All documents of a text, normalised, distinct: CNPJs first, then CPFs with right check digits."""
    cnpj = F.transform(F.regexp_extract_all(c, F.lit(CNPJ_IN_TEXT), F.lit(0)), lambda x: normalize_cnpj(x))
    cpf = F.transform(F.regexp_extract_all(c, F.lit(CPF_IN_TEXT), F.lit(0)), lambda x: normalize_cpf(x))
    return F.array_distinct(F.filter(F.concat(cnpj, cpf), lambda x: x.isNotNull()))


def strip_documents(c: Column) -> Column:
    """A text without its documents and the words that label them."""
    bare = F.regexp_replace(F.regexp_replace(c, CNPJ_IN_TEXT, ""), CPF_IN_TEXT, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)(?<![A-Za-z0-9_])(?:CPF|CNPJ)(?![A-Za-z0-9_])[:\s]*", ""), BLANK, " "))


def _covers(short: Column, long: Column) -> Column:
    """Whether each token of short takes an unused token of long: an equal one, or for a single letter one that starts with it."""

    def fits(t: Column, y: Column) -> Column:
        return (y == t) | ((F.length(t) == 1) & y.startswith(t))

    def take(state: Column, t: Column) -> Column:
        at = F.array_position(F.transform(state["left"], lambda y: fits(t, y)), True)
        left = F.filter(state["left"], lambda y, i: i != at - 1)
        return F.struct(F.when(at > 0, left).otherwise(state["left"]).alias("left"), (state["ok"] & (at > 0)).alias("ok"))

    return F.aggregate(short, F.struct(long.alias("left"), F.lit(True).alias("ok")), take, lambda s: s["ok"])


def names_agree(x: Column, y: Column) -> Column:
    """Whether two names agree, for names that normalize_name() has been over; false where either has three characters or fewer or is null."""
    tx, ty = F.split(x, " "), F.split(y, " ")
    subset = F.when(F.size(tx) < F.size(ty), _covers(tx, ty)).when(F.size(tx) > F.size(ty), _covers(ty, tx)).otherwise(_covers(tx, ty) | _covers(ty, tx))
    long_enough = (F.length(x) > 3) & (F.length(y) > 3)
    return F.coalesce(F.when(long_enough, F.when(x.contains(y) | y.contains(x), True).otherwise(subset)), F.lit(False))


def name_masks(name: Column) -> Column:
    """need and have of a normalised name, for may_agree(): bits of its words and single letters, and of its tokens and their first letters.

    Words take the lower half of a long, letters the upper one.
    """
    bit = lambda t, half: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.pmod(F.xxhash64(t), F.lit(32)) + half).cast("int"))
    letter = lambda t: bit(F.substring(t, 1, 1), 32)
    tokens = F.split(name, " ")
    bits = lambda f: F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, t: a.bitwiseOR(f(t)))
    return F.struct(bits(lambda t: F.when(F.length(t) == 1, letter(t)).otherwise(bit(t, 0))).alias("need"), bits(lambda t: bit(t, 0).bitwiseOR(letter(t))).alias("have"))


def may_agree(x: Column, y: Column, mx: Column, my: Column) -> Column:
    """Whether two names (with their name_masks) may agree; false for most that don't, and never for two that do."""
    within = lambda a, b: a["need"].bitwiseAND(F.bitwise_not(b["have"])) == 0
    return x.contains(y) | y.contains(x) | within(mx, my) | within(my, mx)


def compare_names(a: Column, b: Column) -> Column:
    """bate, difere or indefinido for two names.

    Names of three characters or fewer say nothing. Equal names agree, so does one within the other, and one whose
    tokens are all found in the other, single letters standing for any token that starts with them.
    """
    x, y = normalize_name(F.coalesce(a, F.lit(""))), normalize_name(F.coalesce(b, F.lit("")))
    return F.when((F.length(x) <= 3) | (F.length(y) <= 3), "indefinido").when(names_agree(x, y), "bate").otherwise("difere")
