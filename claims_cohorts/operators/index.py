"""Index-date finders and the span filter.

All finders work on compacted claims (one row per member and day with a row count),
so a window partition holds at most one row per calendar day of a member's history,
however many claim rows the member has.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claims_cohorts.columns import DATE, INDEX, MEMBER
from claims_cohorts.operators.claims import N_CLAIMS, compact_claims


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def first_pair_index(
    claims: DataFrame,
    min_days: int | Column = 30,
    min_claims: int | Column = 2,
    keys: Sequence[str] = (),
    member_col: str = MEMBER,
    date_col: str = DATE,
    within_days: int | Column | None = None,
    span_min_claims: int | Column = 2,
) -> DataFrame:
    """Earliest claim followed by the next claim at least ``min_days`` later.

    Claims are ordered by date per member; the index is the earlier date of the
    first consecutive pair whose gap is ``>= min_days``. ``min_claims`` is accepted
    and not used (a pair always needs two rows). Two rows on one day form a pair
    with gap 0, which counts when ``min_days <= 0``.

    With ``within_days`` the span filter (see :func:`span_filter`) is applied in
    the same aggregate, since both group by member over the same claims.
    """
    del min_claims
    c = compact_claims(claims, keys, member_col, date_col)
    md = _lit(min_days)
    w = Window.partitionBy(*keys, member_col).orderBy(date_col)
    gap = F.datediff(F.lead(date_col).over(w), F.col(date_col))
    ok = F.coalesce((gap >= md) | ((F.col(N_CLAIMS) >= 2) & (F.lit(0) >= md)), F.lit(False))
    grouped = c.withColumn("_ok", ok).groupBy(*keys, member_col)
    if within_days is None:
        return grouped.agg(F.min(F.when(F.col("_ok"), F.col(date_col))).alias(INDEX)).where(F.col(INDEX).isNotNull())
    stats = grouped.agg(
        F.min(F.when(F.col("_ok"), F.col(date_col))).alias(INDEX),
        F.sum(N_CLAIMS).alias("_rows"),
        F.min(date_col).alias("_first"),
        F.max(date_col).alias("_last"),
    )
    within = _lit(within_days)
    span_ok = within.isNull() | (
        (F.col("_rows") >= _lit(span_min_claims)) & (F.datediff(F.col("_last"), F.col("_first")) <= within)
    )
    return stats.where(F.col(INDEX).isNotNull() & span_ok).select(*keys, member_col, INDEX)


def second_claim_index(
    claims: DataFrame,
    min_days: int | Column = 30,
    min_rows: int | Column = 2,
    keys: Sequence[str] = (),
    member_col: str = MEMBER,
    date_col: str = DATE,
) -> DataFrame:
    """Later date of the first consecutive pair with gap ``>= min_days``.

    Members with fewer than ``min_rows`` claim rows are skipped first.
    """
    c = compact_claims(claims, keys, member_col, date_col)
    md = _lit(min_days)
    w = Window.partitionBy(*keys, member_col).orderBy(date_col)
    whole = Window.partitionBy(*keys, member_col)
    gap = F.datediff(F.col(date_col), F.lag(date_col).over(w))
    ok = (gap >= md) | ((F.col(N_CLAIMS) >= 2) & (F.lit(0) >= md))
    return (
        c.withColumn("_ok", F.coalesce(ok, F.lit(False)))
        .withColumn("_rows", F.sum(N_CLAIMS).over(whole))
        .where(F.col("_ok") & (F.col("_rows") >= _lit(min_rows)))
        .groupBy(*keys, member_col)
        .agg(F.min(date_col).alias(INDEX))
    )


def first_claim_index(
    claims: DataFrame, keys: Sequence[str] = (), member_col: str = MEMBER, date_col: str = DATE
) -> DataFrame:
    """Earliest claim date per member (partial aggregation, no window)."""
    return (
        claims.where(F.col(member_col).isNotNull())
        .groupBy(*keys, member_col)
        .agg(F.min(date_col).alias(INDEX))
        .where(F.col(INDEX).isNotNull())
    )


def span_filter(
    index: DataFrame,
    claims: DataFrame,
    within_days: int | Column | None,
    min_claims: int | Column = 2,
    keys: Sequence[str] = (),
    member_col: str = MEMBER,
    date_col: str = DATE,
) -> DataFrame:
    """Keep index rows whose member has ``>= min_claims`` rows spanning ``<= within_days``.

    The span is last minus first claim date over the member's whole history (not a
    rolling window). A null ``within_days`` (per key) keeps the row unfiltered.
    """
    if within_days is None:
        return index
    c = compact_claims(claims, keys, member_col, date_col)
    stats = c.groupBy(*keys, member_col).agg(
        F.sum(N_CLAIMS).alias("_rows"), F.min(date_col).alias("_first"), F.max(date_col).alias("_last")
    )
    within = _lit(within_days)
    keep = within.isNull() | (
        (F.col("_rows") >= _lit(min_claims)) & (F.datediff(F.col("_last"), F.col("_first")) <= within)
    )
    passed = stats.where(keep).select(*keys, member_col)
    return index.join(passed, [*keys, member_col], "left_semi")


def component_window_index(
    component_claims: DataFrame,
    components: Sequence[str],
    min_components: int = 3,
    window_days: int | Column = 365,
    keys: Sequence[str] = (),
    component_col: str = "component",
    member_col: str = MEMBER,
    date_col: str = DATE,
) -> DataFrame:
    """Earliest component claim date ``s`` with ``>= min_components`` distinct
    components among claims dated in ``[s, s + window_days]``.

    For each component the next occurrence on or after each day comes from one
    running window (descending order, unbounded preceding → current), so the cost
    is linear in the member's distinct (day, component) rows.
    """
    c = (
        component_claims.where(F.col(member_col).isNotNull() & F.col(date_col).isNotNull())
        .select(*keys, member_col, date_col, component_col)
        .distinct()
    )
    w_next = (
        Window.partitionBy(*keys, member_col)
        .orderBy(F.unix_date(F.col(date_col)).desc())
        .rangeBetween(Window.unboundedPreceding, 0)
    )
    end = F.date_add(F.col(date_col), _lit(window_days))
    present = []
    for comp in components:
        nxt = F.min(F.when(F.col(component_col) == comp, F.col(date_col))).over(w_next)
        present.append(F.when(nxt <= end, 1).otherwise(0))
    n_present = present[0]
    for p in present[1:]:
        n_present = n_present + p
    return (
        c.withColumn("_n", n_present)
        .where(F.col("_n") >= min_components)
        .groupBy(*keys, member_col)
        .agg(F.min(date_col).alias(INDEX))
    )


def rolling_claims_index(
    claims: DataFrame, k: int, window_days: int, keys: Sequence[str] = (), distinct_days: bool = False
) -> DataFrame:
    """(keys, member, index_date, window_start): the first day on which the member's claims of
    the last ``window_days`` days, that day included, number ``k`` or more, and the first of them.

    Claims of one day count each, or once with ``distinct_days``. A range frame over the
    compacted days sums them, so a member's work is bounded by calendar days. This is the rolling
    reading of "k claims within a period"; :func:`first_pair_index` tests the whole history.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    days = compact_claims(claims, keys)
    n = F.lit(1) if distinct_days else F.col(N_CLAIMS)
    last = Window.partitionBy(*keys, MEMBER).orderBy(F.unix_date(DATE)).rangeBetween(-window_days, 0)
    days = days.where(F.col(DATE).isNotNull()).withColumns({"_n": F.sum(n).over(last), "_from": F.min(DATE).over(last)})
    reached = days.where(F.col("_n") >= k).groupBy(*keys, MEMBER)
    return reached.agg(F.min(DATE).alias(INDEX), F.min("_from").alias("window_start"))
