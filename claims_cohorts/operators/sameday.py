"""Rules on what else was coded on the same day: a chapter bitmap per member and day."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import DATE, ICD, MEMBER
from claims_cohorts.functions.chapters import CodeRanges, chapter_ranges, icd10_chapter

CHAPTERS = "chapters"


def chapter_days(claims: DataFrame, ranges: CodeRanges | None = None) -> DataFrame:
    """(member, day, chapters): bit n is set if a code of that day lies in range n.

    ``ranges`` defaults to the ICD-10-CM chapters, bit 1 to bit 22. Days without such a code,
    and rows without a member or date, are left out. The bits are combined map-side, so a
    member's rows shrink to one a day before they are shuffled.
    """
    number = icd10_chapter(ICD) if ranges is None else ranges.number(ICD)
    rows = claims.select(MEMBER, DATE, number.alias("_n")).where(F.col("_n").isNotNull() & F.col(MEMBER).isNotNull() & F.col(DATE).isNotNull())
    bit = F.expr("shiftleft(1L, _n)")
    return rows.groupBy(MEMBER, DATE).agg(F.bit_or(bit).alias(CHAPTERS))


def exclude_same_day_chapters(rows: DataFrame, claims: DataFrame, chapters: Sequence[str | int], date_col: str = DATE) -> DataFrame:
    """Drop the rows whose member has, on the row's day, a diagnosis of one of the chapters.

    Works on claim rows and on index rows (``date_col``). ``claims`` are all diagnosis claims; only
    those of the chapters are shuffled. Rows without a member or date stay.
    """
    if not chapters:
        return rows
    days = chapter_days(claims, chapter_ranges(chapters)).select(F.col(MEMBER).alias("_member"), F.col(DATE).alias("_day"))
    return rows.join(days, (rows[MEMBER] == days["_member"]) & (rows[date_col] == days["_day"]), "left_anti")
