"""Rule semantics as Column builders: null means unknown, never zero.

Comparisons and arithmetic pass null on. `both` and `either` are two-valued: an unknown part
counts as false and the result is never null, so "missing or within the limit" passes only
where a rule says so. All tests are total, since Spark may work out any branch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Logic


def truth(c: C) -> Column:
    return F.coalesce(col(c), F.lit(False))


def both(*parts: C) -> Column:
    return reduce(lambda a, b: a & b, map(truth, parts))


def either(*parts: C) -> Column:
    return reduce(lambda a, b: a | b, map(truth, parts))


def negate(c: C) -> Column:
    return ~truth(c)


def is_missing(c: C, kind: str = "number") -> Column:
    """Null, a blank text or an empty collection; zero is present. kind: number, text or array."""
    c = col(c)
    if kind == "text":
        return c.isNull() | (F.trim(c) == "")
    if kind == "array":
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def is_present(c: C, kind: str = "number") -> Column:
    return ~is_missing(c, kind)


def default(c: C, other: C, kind: str = "number") -> Column:
    return F.when(is_missing(c, kind), col(other)).otherwise(col(c))


def within_tolerance(a: C, b: C, tolerance: float = 100) -> Column:
    return F.coalesce(F.abs(col(a) - col(b)) <= tolerance, F.lit(False))


# Numbers


def ratio(a: C, b: C) -> Column:
    """Null on a null or zero divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def percent(a: C, b: C) -> Column:
    return ratio(a, b) * 100


def floor_divide(a: C, b: C) -> Column:
    return F.floor(ratio(a, b))


def modulo(a: C, b: C) -> Column:
    return F.when(col(b) != 0, F.pmod(col(a), col(b)))


def round_even(c: C, places: int = 0) -> Column:
    return F.bround(col(c), places)


def to_int(c: C) -> Column:
    """Toward zero."""
    c = col(c).cast("double")
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("long")


def paise_to_rupees(c: C) -> Column:
    return col(c).cast("double") / 100


def rupees_to_paise(c: C) -> Column:
    return F.bround(col(c).cast("double") * 100).cast("long")


def smallest(*parts: C) -> Column:
    return F.least(*map(col, parts))


def largest(*parts: C) -> Column:
    return F.greatest(*map(col, parts))


def clamp(c: C, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


# Wage rows


def statutory_wages(basic: C = "basic_paise", da: C = "da_paise") -> Column:
    """Null only if both parts are."""
    basic, da = col(basic), col(da)
    zero = F.lit(0).cast("long")
    return F.when(basic.isNotNull() | da.isNotNull(), F.coalesce(basic, zero) + F.coalesce(da, zero))


def total_remuneration(basic: C = "basic_paise", da: C = "da_paise", other: C = "other_allowances_paise", gross: C = "gross_paise") -> Column:
    """The sum of what is there; the gross where no part is."""
    parts = [col(basic), col(da), col(other)]
    some = reduce(lambda a, b: a | b, (p.isNotNull() for p in parts))
    return F.when(some, reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0).cast("long")) for p in parts))).otherwise(col(gross))


def ordinary_hourly_rate(wages: C, days: C = "days_paid", hours: C = "normal_hours_per_day") -> Column:
    """Eight hours a day where none or zero are given; null without wages or days."""
    hours = F.coalesce(F.nullif(col(hours), F.lit(0.0)), F.lit(8.0))
    return F.when((col(wages) != 0) & (col(days) > 0), F.try_divide(col(wages).cast("double"), col(days) * hours))


# Dates


def days_between(a: C, b: C) -> Column:
    return F.datediff(col(b), col(a))


def is_after(a: C, b: C) -> Column:
    return truth(col(a) > col(b))


def is_before(a: C, b: C) -> Column:
    return truth(col(a) < col(b))


def add_days(a: C, n: C | int) -> Column:
    return F.date_add(col(a), n if isinstance(n, int) else col(n))


def is_expired(valid_to: C, on: C) -> Column:
    """An open end never expires."""
    return truth(col(on) > col(valid_to))


def day_of_month(a: C) -> Column:
    return F.dayofmonth(col(a))


def month_end_day(a: C) -> Column:
    return F.dayofmonth(F.last_day(col(a)))


# Texts


def text_contains(text: C, part: C) -> Column:
    return truth(F.contains(F.lower(col(text)), F.lower(col(part))))


def matches_any(text: C, *options: str) -> Column:
    return truth(F.lower(F.trim(col(text))).isin([o.strip().lower() for o in options]))


def normalise_number(text: C) -> Column:
    """Letters and digits only, upper case."""
    return F.upper(F.regexp_replace(col(text), r"[^\p{L}\p{Nd}]", ""))


def has_length(text: C, n: int) -> Column:
    return truth(F.length(normalise_number(text)) == n)


def is_all_digits(text: C) -> Column:
    return truth(F.col(text).rlike("^[0-9]+$") if isinstance(text, str) else text.rlike("^[0-9]+$"))


def length_of(c: C, kind: str = "text") -> Column:
    c = col(c)
    return F.when(c.isNull(), 0).otherwise(F.size(c) if kind == "array" else F.length(c))


# Aggregates over the rows of a group


def total(c: C) -> Column:
    return F.coalesce(F.sum(col(c)), F.lit(0))


def count_rows() -> Column:
    return F.count(F.lit(1))


def count_missing(c: C, kind: str = "number") -> Column:
    return F.count_if(is_missing(c, kind))


def count_below(c: C, limit: C) -> Column:
    return F.count_if(truth(col(c) < col(limit)))


def count_above(c: C, limit: C) -> Column:
    return F.count_if(truth(col(c) > col(limit)))


def count_equal(c: C, value: C) -> Column:
    return F.count_if(truth(col(c) == col(value)))


def count_nonzero(c: C) -> Column:
    return F.count_if(truth(col(c) != 0))


def all_below(c: C, limit: C) -> Column:
    return F.count_if(truth(col(c) >= col(limit))) == 0


def all_at_least(c: C, limit: C) -> Column:
    return F.count_if(truth(col(c) < col(limit))) == 0


def unique_count(c: C) -> Column:
    return F.count_distinct(col(c))


def unique(values: Column | str) -> Column:
    """The distinct items of an array in the order of their first mention."""
    return F.array_distinct(col(values))
