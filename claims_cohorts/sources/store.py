"""A claims store laid out for the joins: catalog tables bucketed and sorted by claim_entry_id.

Entries and line tables that are bucketed alike join on ``claim_entry_id`` bucket by bucket,
without a shuffle of either side. Written once, read with ``load_catalog``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from claims_cohorts.columns import CLAIM_ID, MEMBER
from claims_cohorts.sources.tables import FACT_TABLES, ClaimsTables, load_catalog

#: Spark's limit on buckets (``spark.sql.sources.bucketing.maxBuckets``).
MOST_BUCKETS = 100_000
#: Bytes of a fact table that one bucket should hold.
BUCKET_BYTES = 256 << 20


def buckets_for(largest_table_bytes: int) -> int:
    """Number of buckets for the largest fact table, a power of two so that a store with fewer
    or more buckets still lines up with it."""
    n = 1
    while n * BUCKET_BYTES < largest_table_bytes and 2 * n <= MOST_BUCKETS:
        n *= 2
    return n


def write_claim_store(spark: SparkSession, tables: ClaimsTables, database: str, buckets: int) -> ClaimsTables:
    """Write ``tables`` to the catalog database and return them as read from it.

    Fact tables are bucketed and sorted by claim_entry_id, members and eligibility by
    member. Rows are dealt to their bucket before the write, so a bucket is one file and
    not one of every task; a hot claim id can't arise, as an entry has a bounded number
    of lines. Rows without an id are spread at random: they join with nothing, but
    a missing id must not fill one bucket's task.
    """
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MOST_BUCKETS}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in tables.as_dict().items():
        key = CLAIM_ID if name in FACT_TABLES else MEMBER
        if key not in df.columns:
            df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
            continue
        at = F.pmod(F.hash(F.col(key)), F.lit(buckets))
        dealt = df.repartition(buckets, F.when(F.col(key).isNull(), F.floor(F.rand(17) * buckets)).otherwise(at))
        dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"`{database}`.`{name}`")
    return load_catalog(spark, database)
