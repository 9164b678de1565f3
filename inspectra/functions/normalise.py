"""Raw cells to typed values, as whole-column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inspectra.functions.predicates import col

# What stands for an empty cell, date formats in order, skills, tokens that tell no names apart, cells of total and of header rows.
BLANKS = ["", "null", "none", "n/a", "na", "-", "--"]
DATE_FORMATS = ["yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM yyyy", "MMM yyyy", "yyyy-M", "M/yyyy"]
# Shapes that a text must have to fit the format at its place: no parser is asked, and none throws, that cannot fit.
_DAY, _YEAR, _LONG, _SHORT = r"[+-]?\d{1,19}", r"[+-]?\d{4,19}", r"(?:[Mm][Aa][Yy]|[^\d\s]{4,})", r"[^\d\s]{3,5}"
DATE_SHAPES = [
    f"{_YEAR}-{_DAY}-{_DAY}", f"{_DAY}-{_DAY}-{_YEAR}", f"{_DAY}/{_DAY}/{_YEAR}", rf"{_DAY}\.{_DAY}\.{_YEAR}", f"{_DAY} {_LONG} {_YEAR}", f"{_DAY} {_SHORT} {_YEAR}", f"{_LONG} {_YEAR}", f"{_SHORT} {_YEAR}", f"{_YEAR}-{_DAY}", f"{_DAY}/{_YEAR}",
]
SKILLS = ["UNSKILLED", "SEMI_SKILLED", "SKILLED", "HIGHLY_SKILLED"]
NOISE_TOKENS = ["SHRI", "SHRIMATI", "SMT", "SRI", "MR", "MRS", "MS", "MISS", "MASTER", "SARDAR", "LATE", "DECEASED", "SO", "DO", "WO", "CO", "OF"]
TOTAL_MARKS = ["TOTAL", "GRAND TOTAL", "SUBTOTAL", "SUB-TOTAL", "SUB TOTAL", "C/F", "C-F", "B/F", "B-F", "CARRIED FORWARD", "BROUGHT FORWARD"]
HEADER_MARKS = ["WORKER NAME", "EMPLOYEE NAME", "MEMBER NAME", "NAME OF WORKER", "NAME OF EMPLOYEE", "NAME"]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(c: Column | str) -> Column:
    """N1"""
    text = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.when(~F.lower(text).isin(BLANKS), text)


def parse_number(c: Column | str) -> Column:
    """N2"""
    return F.regexp_replace(clean_text(c), ",", "").try_cast("double")


def parse_int(c: Column | str) -> Column:
    """Half to even."""
    return F.bround(parse_number(c), 0).cast("long")


def parse_date(c: Column | str) -> Column:
    """The first format that fits, day first; a month alone is its first day."""
    one = lambda t, shape, f: F.when(t.rlike(f"^{shape}$"), F.try_to_timestamp(t, F.lit(f)).cast("date"))
    return _once(F.trim(F.regexp_replace(col(c), r"\s+", " ")), lambda t: F.coalesce(*(one(t, shape, f) for f, shape in zip(DATE_FORMATS, DATE_SHAPES))))


def parse_paise(c: Column | str) -> Column:
    """Amounts in rupees to paise, half up; brackets are negative."""

    def paise(text: Column) -> Column:
        value = F.round(F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("decimal(30,10)") * 100, 0).cast("long")
        return F.when(text.startswith("(") & text.endswith(")"), -F.abs(value)).otherwise(value)

    return _once(clean_text(c), paise)


def parse_skill(c: Column | str) -> Column:
    """N6"""
    text = F.translate(F.upper(clean_text(c)), " -", "__")
    return F.when(text.isin(SKILLS), text)


def longest_run(c: Column | str) -> Column:
    """Longest run of worked marks. Absences, offs and separators break a run; other symbols do neither. Null with fewer than three marks of either kind."""
    marks = F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}\- ./]", "")
    runs = F.split(F.regexp_replace(marks, r"[awhlox\- ./]", " "), " ")
    return F.when(F.length(marks) >= 3, F.array_max(F.transform(runs, lambda r: F.length(r))))


def digits_only(c: Column | str) -> Column:
    """N8"""
    return F.regexp_replace(col(c), r"\D", "")


def name_key(c: Column | str) -> Column:
    """Upper-case tokens up to a relation, without punctuation and noise tokens."""
    text = F.regexp_replace(F.upper(col(c)), r"\b([SDWC]\s*/\s*O|(SON|DAUGHTER|WIFE)\s+OF)\b[\s\S]*$", "")
    tokens = F.split(F.trim(F.regexp_replace(text, r"[^A-Z0-9\s]", " ")), r"\s+")
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(NOISE_TOKENS) & (t != "")), " ")


def row_reason(name: Column | str, page_known: Column, has_id: Column, repeated: Column) -> Column:
    """Why a row is removed, first reason first; null: accepted."""
    text = F.trim(F.regexp_replace(F.upper(F.translate(F.coalesce(col(name), F.lit("")), ".", " ")), r"\s+", " "))
    return reduce(
        lambda so_far, step: so_far.when(step[0], step[1]),
        [(text.isin(TOTAL_MARKS), "total"), (text.isin(HEADER_MARKS) & ~has_id, "header"), (repeated, "duplicate")],
        F.when(~page_known, "bad_page"),
    )
