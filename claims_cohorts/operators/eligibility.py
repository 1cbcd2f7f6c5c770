"""Enrollment checks against eligibility spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import ENROLL_END, ENROLL_START, INDEX, MEMBER
from claims_cohorts.functions.dates import month_spine
from claims_cohorts.operators.intervals import merged_intervals

# FIXED VALUES — termination date assumed for open-ended enrollment.
OPEN_END = "2099-12-31"


def first_enrollment(eligibility: DataFrame, start_col: str = ENROLL_START, end_col: str = ENROLL_END) -> DataFrame:
    """One eligibility row per member: the earliest start, then earliest end (nulls last).

    ``min_by`` is a partial aggregate, so a member with many rows is reduced map-side.
    """
    s, e = F.col(start_col).cast("date"), F.col(end_col).cast("date")
    order = F.struct(s.isNull(), s, e.isNull(), e)
    picked = eligibility.groupBy(MEMBER).agg(F.min_by(F.struct(s.alias("s"), e.alias("e")), order).alias("_row"))
    return picked.select(MEMBER, F.col("_row.s").alias(start_col), F.col("_row.e").alias(end_col))


def enrollment_filter(
    index: DataFrame,
    eligibility: DataFrame,
    lookback_days: int = 365,
    lookahead_days: int = 365,
    start_col: str = ENROLL_START,
    end_col: str = ENROLL_END,
) -> DataFrame:
    """Keep index rows enrolled from ``index - lookback`` through ``index + lookahead``.

    Only the member's first eligibility row counts; a null end means open-ended; a
    null start or no eligibility row drops the index row.
    """
    first = first_enrollment(eligibility, start_col, end_col)
    end = F.coalesce(first[end_col], F.lit(OPEN_END).cast("date"))
    cond = (
        (index[MEMBER] == first[MEMBER])
        & (first[start_col] <= F.date_sub(index[INDEX], lookback_days))
        & (end >= F.date_add(index[INDEX], lookahead_days))
    )
    return index.join(first, cond, "left_semi")


def enrollment_spans(
    eligibility: DataFrame, allowed_gap_days: int = 0, start_col: str = ENROLL_START, end_col: str = ENROLL_END
) -> DataFrame:
    """(member, start, end): a member's eligibility rows merged into continuous enrollment,
    gaps of up to ``allowed_gap_days`` days included. Rows without a start are left out, a null
    end means open-ended."""
    end = F.coalesce(F.col(end_col).cast("date"), F.lit(OPEN_END).cast("date"))
    return merged_intervals(eligibility.select(MEMBER, F.col(start_col), end.alias(end_col)), start_col, end_col, gap_days=allowed_gap_days)


def continuous_enrollment(
    index: DataFrame,
    eligibility: DataFrame,
    lookback_days: int = 365,
    lookahead_days: int = 365,
    allowed_gap_days: int = 0,
    start_col: str = ENROLL_START,
    end_col: str = ENROLL_END,
) -> DataFrame:
    """Keep index rows that one continuous enrollment covers from ``index - lookback`` through
    ``index + lookahead``.

    Unlike :func:`enrollment_filter` all eligibility rows of a member count, however they
    overlap, and short gaps between them can be allowed. Rows of members without an
    index date are dropped before any window sees them.
    """
    wanted = eligibility.join(index.select(MEMBER).distinct(), MEMBER, "left_semi")
    spans = enrollment_spans(wanted, allowed_gap_days, start_col, end_col)
    cond = (
        (index[MEMBER] == spans[MEMBER])
        & (spans[start_col] <= F.date_sub(index[INDEX], lookback_days))
        & (spans[end_col] >= F.date_add(index[INDEX], lookahead_days))
    )
    return index.join(spans, cond, "left_semi")


def enrollment_months(eligibility: DataFrame, as_of, start_col: str = ENROLL_START, end_col: str = ENROLL_END) -> DataFrame:
    """Member-month spine: one row per member and month start covered by enrollment.

    Open-ended enrollment runs through ``as_of``.
    """
    spans = eligibility.select(MEMBER, F.col(start_col).cast("date").alias("_s"), F.col(end_col).cast("date").alias("_e"))
    return month_spine(spans, "_s", "_e", [MEMBER], open_end=as_of)
