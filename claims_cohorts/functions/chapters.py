"""ICD-10-CM chapters as an ordered range map, searched inside the plan.

A map holds disjoint ranges of three-character categories, each with a number. Its lookup is
a binary search written as nested comparisons on the code: some five string comparisons a row,
in the JVM, with no join and no function of ours in the data path.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES — the chapters of ICD-10-CM: number, first and last category.
ICD10_CHAPTERS = [
    (1, "A00", "B99"), (2, "C00", "D49"), (3, "D50", "D89"), (4, "E00", "E89"), (5, "F01", "F99"),
    (6, "G00", "G99"), (7, "H00", "H59"), (8, "H60", "H95"), (9, "I00", "I99"), (10, "J00", "J99"),
    (11, "K00", "K95"), (12, "L00", "L99"), (13, "M00", "M99"), (14, "N00", "N99"), (15, "O00", "O9A"),
    (16, "P00", "P96"), (17, "Q00", "Q99"), (18, "R00", "R99"), (19, "S00", "T88"), (20, "V00", "Y99"),
    (21, "Z00", "Z99"), (22, "U00", "U85"),
]
#: Sorts after every character of a category.
_END = "~"


@dataclass(frozen=True)
class CodeRanges:
    """Disjoint ranges (first, last, number) of category prefixes, in order of their first."""

    ranges: tuple[tuple[str, str, int], ...]

    @staticmethod
    def of(ranges: Sequence[tuple[str, str, int]]) -> "CodeRanges":
        ordered = tuple(sorted(ranges))
        for (_, last, _), (first, _, _) in zip(ordered, ordered[1:]):
            if first <= last:
                raise ValueError(f"overlapping code ranges: one ends at {last!r}, the next begins at {first!r}")
        for first, last, _ in ordered:
            if last < first:
                raise ValueError(f"code range {first!r} to {last!r} is empty")
        return CodeRanges(ordered)

    def number(self, code: Column | str) -> Column:
        """Number of the range that holds the code's category; null if none does."""
        key = F.substring(code if isinstance(code, Column) else F.col(code), 1, 3)

        def find(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                _, last, number = self.ranges[lo]
                return F.when(key <= last, F.lit(number))
            mid = (lo + hi) // 2
            return F.when(key >= self.ranges[mid][0], find(mid, hi)).otherwise(find(lo, mid))

        if not self.ranges:
            return F.lit(None).cast("int")
        return F.when(key >= self.ranges[0][0], find(0, len(self.ranges)))


def icd10_chapter(code: Column | str) -> Column:
    """Chapter number (1 to 22) of an ICD-10-CM code, dotted or not; null for any other text."""
    return CodeRanges.of([(first, last, n) for n, first, last in ICD10_CHAPTERS]).number(code)


def chapter_ranges(chapters: Sequence[str | int]) -> CodeRanges:
    """The ranges of a configured list, numbered by their place in it.

    An item is a letter or a longer prefix (``S``, ``T8``), a range of categories (``S00-T88``)
    or the number of an ICD-10-CM chapter (``19``). Overlapping items raise ``ValueError``.
    """
    by_number = {n: (first, last) for n, first, last in ICD10_CHAPTERS}
    out = []
    for place, item in enumerate(chapters):
        text = str(item).strip()
        if text.isdigit():
            if int(text) not in by_number:
                raise ValueError(f"no ICD-10-CM chapter {text}")
            first, last = by_number[int(text)]
        elif "-" in text:
            first, last = (part.strip()[:3] for part in text.split("-", 1))
        else:
            first = last = text[:3]
        if not first or not last:
            raise ValueError(f"not a chapter: {item!r}")
        # a last category shorter than three characters covers all that begin with it
        out.append((first, last + _END * (3 - len(last)), place))
    return CodeRanges.of(out)
