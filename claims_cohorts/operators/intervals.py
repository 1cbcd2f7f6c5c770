"""Time intervals per member: merging, episodes of claims, and overlap joins.

Intervals are closed and in days. Merging and episodes are gaps-and-islands windows over one
row per member and day; overlap joins are equi-joins on time buckets, so neither compares all
intervals of a member with each other.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claims_cohorts.columns import DATE, INDEX, MEMBER
from claims_cohorts.operators.claims import N_CLAIMS, compact_claims

EPISODE, EPISODE_START, EPISODE_END = "episode", "episode_start", "episode_end"
#: Days in a bucket of an overlap join.
BUCKET_DAYS = 128


def merged_intervals(spans: DataFrame, start_col: str, end_col: str, keys: Sequence[str] = (MEMBER,), gap_days: int = 0) -> DataFrame:
    """(keys, start, end) with overlapping, nested and adjacent intervals merged, also those
    with at most ``gap_days`` uncovered days between them.

    Intervals without a key, a start or an end, or that end before they begin, are left out. Of
    the intervals that begin on one day only the longest matters; it is found map-side, so a
    key's window holds at most a row per calendar day.
    """
    s, e = F.col(start_col).cast("date"), F.col(end_col).cast("date")
    valid = [F.col(k).isNotNull() for k in keys] + [s <= e]
    rows = spans.select(*keys, s.alias("_s"), e.alias("_e"))
    for v in valid[:-1]:
        rows = rows.where(v)
    rows = rows.where("_s <= _e").groupBy(*keys, "_s").agg(F.max("_e").alias("_e"))
    order = Window.partitionBy(*keys).orderBy("_s")
    reached = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = reached.isNull() | (F.datediff("_s", reached) > gap_days + 1)
    rows = rows.withColumn("_begins", begins.cast("int"))
    rows = rows.withColumn("_island", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*keys, "_island").agg(F.min("_s").alias(start_col), F.max("_e").alias(end_col))
    return out.select(*keys, start_col, end_col)


def claim_episodes(claims: DataFrame, max_gap_days: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, member, episode, episode_start, episode_end, n_days, n_claims): runs of claim days of
    which each is at most ``max_gap_days`` after the one before, numbered from 1 by date."""
    days = compact_claims(claims, keys).where(F.col(DATE).isNotNull())
    order = Window.partitionBy(*keys, MEMBER).orderBy(DATE)
    gap = F.datediff(DATE, F.lag(DATE).over(order))
    days = days.withColumn("_begins", F.coalesce(gap > max_gap_days, F.lit(True)).cast("int"))
    days = days.withColumn(EPISODE, F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return days.groupBy(*keys, MEMBER, EPISODE).agg(
        F.min(DATE).alias(EPISODE_START), F.max(DATE).alias(EPISODE_END), F.count(F.lit(1)).alias("n_days"), F.sum(N_CLAIMS).alias(N_CLAIMS)
    )


def _bucket(day: Column, width: int) -> Column:
    return F.floor(F.unix_date(day) / width).cast("int")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    keys: Sequence[str] = (MEMBER,),
    bucket_days: int = BUCKET_DAYS,
) -> DataFrame:
    """All pairs of rows of equal keys whose intervals share a day: the columns of ``left``, then
    those of ``right`` but for the keys.

    Both sides are dealt into the buckets their intervals touch and joined on (keys, bucket); a
    pair counts in the bucket where the later of both starts lies, hence once. Adaptive execution
    may split a hot bucket, as nothing above the join needs it whole.
    """
    (ls, le), (rs, re) = left_span, right_span
    bucketed = lambda df, s, e, p: df.select(
        "*", s.alias(f"_{p}s"), e.alias(f"_{p}e")
    ).where(F.col(f"_{p}s") <= F.col(f"_{p}e")).withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(f"_{p}s"), bucket_days), _bucket(F.col(f"_{p}e"), bucket_days))))
    own = [c for c in right.columns if c not in keys]
    joined = bucketed(left, ls, le, "l").join(bucketed(right, rs, re, "r"), [*keys, "_bucket"])
    meet = (F.col("_ls") <= F.col("_re")) & (F.col("_rs") <= F.col("_le"))
    first = _bucket(F.greatest("_ls", "_rs"), bucket_days) == F.col("_bucket")
    return joined.where(meet & first).select(*left.columns, *own)


def index_in_episode(index: DataFrame, episodes: DataFrame, before_days: int = 0, after_days: int = 0) -> DataFrame:
    """Index rows joined to the episodes they fall into, from ``before_days`` before an episode's
    first to ``after_days`` after its last claim. Widened episodes may overlap; each gives a row."""
    start, end = F.date_sub(F.col(EPISODE_START), before_days), F.date_add(F.col(EPISODE_END), after_days)
    day = F.col(INDEX).cast("date")
    return overlap_join(index, episodes.select(MEMBER, EPISODE, EPISODE_START, EPISODE_END), (day, day), (start, end))


def filter_by_episode(index: DataFrame, episodes: DataFrame, before_days: int = 0, after_days: int = 0, inside: bool = True) -> DataFrame:
    """Index rows that fall into an episode (or, with ``inside`` False, into none)."""
    hit = index_in_episode(index.select(MEMBER, INDEX).distinct(), episodes, before_days, after_days).select(MEMBER, INDEX).distinct()
    return index.join(hit, [MEMBER, INDEX], "left_semi" if inside else "left_anti")
