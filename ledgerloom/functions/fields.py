"""Column expressions over the fields of statement lines: amounts, hours, file roles, dates, text cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.documents import normalize_name

# What a history line says before the counterparty's name.
HISTORY_PREFIXES = (
    "PIX RECEBIDO", "PIX ENVIADO", "TED ENVIADA", "TED RECEBIDA", "TED ENVIADO", "TED RECEBIDO", "DOC ENVIADO", "DOC RECEBIDO",
    "PIX EMITIDO", "PIX TRANSF", "TRANSF PIX", "TED TRANSF", "PIX PGTO", "PGTO PIX", "PIX DEVOLUCAO", "PIX DEV", "PIX RECEB",
    "PIX ENV", "TED RECEB", "TED ENV", "DOC RECEB", "DOC ENV",
)
# National holidays of fixed date, month and day.
HOLIDAYS = {"01-01": "Ano Novo", "04-21": "Tiradentes", "05-01": "Dia do Trabalho", "09-07": "Independência", "10-12": "Nossa Senhora Aparecida", "11-02": "Finados", "11-15": "Proclamação da República", "11-20": "Consciência Negra", "12-25": "Natal"}
#: Days that a statement line may lag behind its payment.
WINDOW = 3


def file_role(name: Column) -> Column:
    """PIX, COMPLETO or OUTRO, by a statement file's name."""
    return F.when(name.rlike("(?i)pix"), "PIX").when(name.rlike("(?i)total|completo"), "COMPLETO").otherwise("OUTRO")


def amount_br(text: Column) -> Column:
    """A Brazilian amount text as decimal(15,2): blanks and dots go, a comma is the point, the longest numeric head counts."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[\s. ]", ""), ",", ".")
    return F.nullif(F.regexp_extract(plain, r"^[+-]?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("decimal(15,2)")


def hour_minutes(text: Column) -> Column:
    """Minutes since midnight of HH:MM[:SS], or null."""
    h, m = (F.regexp_extract(text, r"^\s*([0-9]{1,2}):([0-9]{2})(?::[0-9]{2})?\s*$", k).try_cast("int") for k in (1, 2))
    return F.when((h < 24) & (m < 60), h * 60 + m)


def day_and_minutes(document: Column) -> Column:
    """The day and minutes that a six-digit document number DDHHMM names, or null."""
    d, h, m = (F.regexp_extract(document, r"^([0-9]{2})([0-9]{2})([0-9]{2})$", k).try_cast("int") for k in (1, 2, 3))
    return F.when(d.between(1, 31) & (h < 24) & (m < 60), F.struct(d.alias("day"), (h * 60 + m).alias("minutes")))


def counterparty_of_history(history: Column) -> Column:
    """The name after a known prefix and a dash, or null."""
    found = F.regexp_extract(F.trim(history), rf"(?i)^(?:{'|'.join(HISTORY_PREFIXES)})\s*-\s*(.+)$", 1)
    return F.when(F.trim(found) != "", normalize_name(found))


def month_bounds(month: str) -> tuple[str, str]:
    """First and last day of YYYY-MM as SQL expressions."""
    year, m = month.split("-")
    if not (len(year) == 4 and 1 <= int(m) <= 12):
        raise ValueError(f"not a month: {month}")
    return f"make_date({int(year)}, {int(m)}, 1)", f"last_day(make_date({int(year)}, {int(m)}, 1))"


def date_gap_reason(pix: Column, full: Column) -> tuple[Column, Column]:
    """Why a statement's date differs from its payment's, and ok, info or warn."""
    gap = F.date_diff(full, pix)
    weekend = F.dayofweek(pix).isin(1, 7) | F.exists(F.sequence(pix, full), lambda d: F.dayofweek(d).isin(1, 7))
    holiday = reduce(lambda a, kv: F.when(F.exists(F.sequence(pix, full), lambda d: F.date_format(d, "MM-dd") == kv[0]), kv[1]).otherwise(a), reversed(HOLIDAYS.items()), F.lit(None).cast("string"))
    inside = F.when(weekend, "fim de semana").when(holiday.isNotNull(), F.concat(F.lit("feriado: "), holiday)).otherwise("compensação")
    reason = F.when(gap == 0, None).when(gap < 0, "anterior ao PIX").when(gap > WINDOW, "fora da janela").otherwise(inside)
    state = F.when(gap == 0, "ok").when((gap < 0) | (gap > WINDOW) | gap.isNull(), "warn").otherwise("info")
    return F.when(gap.isNull(), "datas inválidas").otherwise(reason), state


def csv_cell(c: Column) -> Column:
    """A CSV cell, quoted where it must be."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def header_key(c: Column) -> Column:
    """A header in small letters without accents, other characters as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(normalize_name(c)), "[^a-z0-9]+", "_"), "^_|_$", "")


def field(fields: Column, key: str, mirrored: Column | None = None) -> Column:
    """An extracted field's text; where it is missing or empty, the mirrored column's."""
    own = F.nullif(F.try_element_at(fields, F.lit(key)), F.lit(""))
    return own if mirrored is None else F.coalesce(own, F.nullif(mirrored, F.lit("")))
