"""Duration text and month spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES — days per duration unit.
DAYS_PER_UNIT = {"M": 30, "D": 1, "Y": 365}


def parse_duration_days(text: str) -> int:
    """'12M' → 360, '30D' → 30, '1Y' → 365; other suffixes raise ``ValueError``.

    ``None`` raises ``AttributeError`` (it has no ``endswith``).
    """
    for unit, days in DAYS_PER_UNIT.items():
        if text.endswith(unit):
            return int(text[:-1]) * days
    raise ValueError(f"Unsupported time format: {text}")


def duration_days(col: Column | str) -> Column:
    """Column form of :func:`parse_duration_days`; bad text fails the query."""
    c = F.col(col) if isinstance(col, str) else col
    number = c.substr(F.lit(1), F.length(c) - 1)
    out = None
    for unit, days in DAYS_PER_UNIT.items():
        branch = number.cast("int") * F.lit(days)
        out = F.when(c.endswith(unit), branch) if out is None else out.when(c.endswith(unit), branch)
    return out.otherwise(F.raise_error(F.concat(F.lit("Unsupported time format: "), F.coalesce(c, F.lit("null")))).cast("int"))


def month_starts(start: Column, end: Column) -> Column:
    """Array of first-of-month dates from ``start``'s month through ``end``; empty if
    ``end`` is before that first month (``sequence`` itself rejects reversed bounds)."""
    first = F.trunc(start, "MM")
    return F.when(
        end >= first, F.sequence(first, end, F.expr("INTERVAL 1 MONTH"))
    ).otherwise(F.array().cast("array<date>"))


def month_spine(
    spans: DataFrame,
    start_col: str,
    end_col: str,
    keys: list[str],
    open_end=None,
    month_col: str = "month_start",
) -> DataFrame:
    """One row per key and month touched by its span (null end → ``open_end``).

    Each span expands locally (no shuffle); its size is bounded by the calendar.
    """
    end = F.col(end_col)
    if open_end is not None:
        end = F.coalesce(end, F.lit(str(open_end)).cast("date"))
    return spans.select(*keys, F.explode(month_starts(F.col(start_col), end)).alias(month_col))
