"""Column expressions that reproduce pandas coercion rules with built-ins.

Everything here returns a ``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS_PER_DAY = 86_400_000_000


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Remove leading and trailing whitespace of any kind (tabs, newlines too)."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"^\s+", ""), r"\s+$", "")


def to_number(c: str | Column, default: float | None = 0.0) -> Column:
    """``pd.to_numeric(errors="coerce").fillna(default)``: bad text becomes default.

    Numbers are converted as they are, only text is parsed. NaN counts as
    missing, like pandas ``fillna``.
    """
    x = _c(c).try_cast("double")
    x = F.nanvl(x, F.lit(None).cast("double"))
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def to_timestamp_lenient(c: str | Column) -> Column:
    """``pd.to_datetime(errors="coerce")`` for ISO text or typed input.

    The result is a wall-clock timestamp without time zone, in UTC: an offset
    in the text is applied (the session time zone is UTC). Text that does not
    parse becomes null.
    """
    return _c(c).try_cast("timestamp").cast("timestamp_ntz")


def floor_days_between(later: Column, earlier: str | Column) -> Column:
    """Whole 24-hour days from ``earlier`` to ``later`` rounded down.

    Equals pandas ``(later - earlier).dt.days``; ``datediff`` would count
    calendar boundaries instead.
    """
    diff = F.unix_micros(later) - F.unix_micros(_c(earlier).cast("timestamp"))
    return F.floor(diff / F.lit(_MICROS_PER_DAY)).cast("long")


def as_of_literal(as_of: str | _dt.datetime) -> Column:
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(as_of).cast("timestamp")


def week_start(c: str | Column) -> Column:
    """Monday of the ISO week holding ``c``, as a date."""
    return F.date_trunc("week", _c(c).cast("timestamp")).cast("date")


def pct_change(cur: Column, prev: Column) -> Column:
    """pandas ``pct_change() * 100``: 0 -> 0 is null, 0 -> x is +/- infinity."""
    return (F.when(prev.isNull(), F.lit(None).cast("double"))
            .when((prev == 0) & (cur == 0), F.lit(None).cast("double"))
            .when((prev == 0) & (cur > 0), F.lit(float("inf")))
            .when(prev == 0, F.lit(float("-inf")))
            .otherwise((cur / prev - 1.0) * 100.0))


def safe_ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den if den else default`` without ANSI divide-by-zero errors."""
    out = F.when((den.isNull()) | (den == 0), F.lit(default).cast("double"))
    return out.otherwise(num.cast("double") / den.cast("double"))
