"""A filter of checked size that keeps other members' rows out of a shuffle.

Window rules look at the events of index members only, yet events of all members would be
shuffled to their member. The index members are hashed into bitmaps (``BUCKETS`` rows of 4 KB,
however many members there are, so they can always be broadcast), and events whose member misses
them are dropped where they are scanned. Members that share a bit with an index member
pass; the rules drop them, as they find no anchor. With many more members than bits the
filter passes more and costs no more. Everything stays lazy and in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import MEMBER

#: Rows of the filter, each a bitmap of 32,768 bits: 2 MB in all.
BUCKETS = 512
_BITS = 32_768


def _hash(member: Column) -> Column:
    return F.pmod(F.xxhash64(member), F.lit(BUCKETS * _BITS)).cast("int")


def member_bitmaps(members: DataFrame) -> DataFrame:
    """(_bucket, _bits): at most ``BUCKETS`` rows, built with a map-side combine."""
    hashed = members.where(F.col(MEMBER).isNotNull()).select(_hash(F.col(MEMBER)).alias("_h"))
    return hashed.groupBy(F.floor(F.col("_h") / _BITS).cast("int").alias("_bucket")).agg(F.bitmap_construct_agg(F.pmod("_h", F.lit(_BITS)).cast("long")).alias("_bits"))


def of_members(events: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``events`` whose member may be one of ``members``."""
    bitmaps = F.broadcast(member_bitmaps(members))
    h = _hash(F.col(MEMBER))
    tested = events.where(F.col(MEMBER).isNotNull()).withColumn("_h", h).withColumn("_bucket", F.floor(F.col("_h") / _BITS).cast("int"))
    hit = F.expr(f"shiftright(cast(conv(hex(substring(_bits, (_h % {_BITS}) div 8 + 1, 1)), 16, 10) as int), _h % 8) & 1 = 1")
    return tested.join(bitmaps, "_bucket").where(hit).select(*events.columns)
