"""Scalar functions whose documented edge cases differ from Spark's built-ins; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring(s: Column, start: Column, length: Column) -> Column:
    """From 1; a start under 1 is 1 and does not shorten the length; a length under 1 gives ''."""
    return F.when(length < 1, F.when(s.isNotNull() & start.isNotNull(), "")).otherwise(F.substring(s, F.greatest(start, F.lit(1)), length))


def lpad(s: Column, n: int, pad: str = " ") -> Column:
    """Cut to n if longer; an empty pad gives ''."""
    return F.lpad(s, n, pad) if pad else F.when(s.isNotNull(), "")


def rpad(s: Column, n: int, pad: str = " ") -> Column:
    return F.rpad(s, n, pad) if pad else F.when(s.isNotNull(), "")


def initcap(s: Column) -> Column:
    """A word is a run of letters and digits."""
    parts = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000_000)))), "")


def chr_(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "utf-32")


def split_part(s: Column, delimiter: str, n: int) -> Column:
    """From 1; '' when out of range or n < 1; an empty delimiter leaves one part, the whole."""
    if n < 1:
        return F.when(s.isNotNull(), "")
    if not delimiter:
        return s if n == 1 else F.when(s.isNotNull(), "")
    return F.split_part(s, F.lit(delimiter), F.lit(n))


def int_div(a: Column, b: Column) -> Column:
    """Truncating division; a zero divisor raises."""
    return F.call_function("div", a, b)


def extract(field: str, t: Column) -> Column:
    """BIGINT fields; DOW is 1 (Monday) to 7, MILLISECOND 0 to 999."""
    field = field.upper()
    if field == "DOW":
        return (F.weekday(t) + 1).cast("long")
    if field == "MILLISECOND":
        return F.date_format(t, "SSS").cast("long")
    if field == "SECOND":
        return F.second(t).cast("long")
    of = {"YEAR": F.year, "QUARTER": F.quarter, "MONTH": F.month, "WEEK": F.weekofyear, "DAY": F.dayofmonth, "DOY": F.dayofyear, "HOUR": F.hour, "MINUTE": F.minute}
    return of[field](t).cast("long")


def to_boolean(s: Column) -> Column:
    """Only 'true', in any case, is true."""
    return F.lower(F.trim(s)) == "true"


def floor_double(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil_double(x: Column) -> Column:
    return F.ceil(x).cast("double")
