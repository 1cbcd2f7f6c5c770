"""Member attributes joined to cohort rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from claims_cohorts.columns import MEMBER


def add_member_info(index: DataFrame, members: DataFrame) -> DataFrame:
    """Left join of index rows with member attributes.

    Unmatched rows keep nulls; duplicate member rows fan out. The index holds a row or
    two per cohort and member, and is the side adaptive execution may split.
    """
    extra = [c for c in members.columns if c != MEMBER]
    return index.join(members, MEMBER, "left").select(*index.columns, *extra)
