"""Connected components of a links table by alternating star contraction.

A distributed union-find: in each round every node points all its neighbours at the least
of them (larger ones, then smaller ones), so trees flatten while they merge. Rounds grow with
the logarithm of the longest path. A node's links are reduced by a minimum, never gathered,
so one node may hold most links. Every round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    return r[0], r[1]


def stars(links: DataFrame) -> DataFrame:
    """(u, v) with v the least node of u's component, for every u other than v that has a
    link. ``links``: (u, v) of comparable ids, in any direction, repeats and loops allowed."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = common.staged(links)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = common.staged(small.where("u <> v").distinct())
        old_state, state = state, _state(after)
        common.unstage(now)
        now = after
        if state == old_state:
            break
    return now
