"""Column expressions shared by the phases. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Written-out legal forms and their usual short forms, the longer first (fixed values).
LEGAL_FORMS = (
    ("LIMITED LIABILITY COMPANY", "LLC"),
    ("LIMITED LIABILITY CO", "LLC"),
    ("LIMITED PARTNERSHIP", "LP"),
    ("INCORPORATED", "INC"),
    ("CORPORATION", "CORP"),
    ("COMPANY", "CO"),
    ("LIMITED", "LTD"),
)
DAYS_PER_YEAR = 365.25


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double; null where b is zero or null."""
    b = b.cast("double")
    return a.cast("double") / F.when(b != 0, b)


def signed_log10(c: Column) -> Column:
    """log10 of the magnitude (at least 1) with the sign; null for zero and null."""
    return F.when(c != 0, F.signum(c) * F.log10(F.greatest(F.lit(1.0), F.abs(c))))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def years_between(start: Column, end: Column) -> Column:
    return days_between(start, end) / F.lit(DAYS_PER_YEAR)


def floored_days(start: Column, end: Column, floor: int = 30) -> Column:
    """Days from start to end, at least ``floor``, which also stands for unknown."""
    return F.greatest(F.lit(floor), F.coalesce(days_between(start, end), F.lit(floor)))


def fiscal_quarter(day: Column, first_month: int = 10) -> Column:
    """``FYyyQq`` of a fiscal year that begins in ``first_month`` of the year before; UNKNOWN for null."""
    shifted = F.add_months(day, 13 - first_month)
    name = F.concat(F.lit("FY"), F.lpad((F.year(shifted) % 100).cast("string"), 2, "0"), F.lit("Q"), F.quarter(shifted).cast("string"))
    return F.coalesce(name, F.lit("UNKNOWN"))


def key_segment(key: Column, at: int, sep: str = "_") -> Column:
    """Segment of a composite key, counted from 1 or from the end; null if there is none."""
    return F.try_element_at(F.split(key, sep), F.lit(at))


def pad_code(c: Column, width: int = 6) -> Column:
    return F.lpad(F.trim(c.cast("string")), width, "0")


def upper_code(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def strip_phrases(c: Column, phrases: Sequence[str]) -> Column:
    """Text without the phrases, longest first, trimmed."""
    for p in sorted(phrases, key=len, reverse=True):
        c = F.replace(c, F.lit(p), F.lit(""))
    return F.trim(c)


def tag_list(*tags: tuple[str, Column], default: str = "ok") -> Column:
    """Names of the conditions that hold, joined by ``;``."""
    found = F.array_join(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in tags])), ";")
    return F.coalesce(F.when(found != "", found), F.lit(default))


def company_key(c: Column) -> Column:
    """A company name in capitals without punctuation (but ``&``), legal forms in short."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"(?U)[^\w\s&]", " "), r"(?U)\s+", " "))
    for long, short in LEGAL_FORMS:
        out = F.regexp_replace(out, rf"\b{long}\b", short)
    return out


def looks_like_id(c: Column) -> Column:
    """Whether a supposed ticker is a numeric identifier: four or more digits and at most one letter."""
    return c.rlike(r"^[0-9]{4,}[A-Z]?$")


def quote_symbol(c: Column) -> Column:
    """A ticker as price sources write it: blanks dropped, classes parted by a hyphen."""
    return F.replace(F.trim(c), F.lit("/"), F.lit("-"))


def us_date(c: Column) -> Column:
    """MM/DD/YYYY as a date, null if it is none."""
    return F.try_to_date(F.trim(c), "MM/dd/yyyy")


def any_keyword(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs anywhere in the text, in any case; null for null."""
    low, hit = F.lower(text), F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return F.when(text.isNotNull(), hit)


def first_match(*rules: tuple[Column, str | None], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds; a label may be null."""
    out = None
    for cond, label in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))
