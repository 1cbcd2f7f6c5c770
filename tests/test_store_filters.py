"""The co-partitioned store, balanced JDBC splits and the member filter."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from claims_cohorts.operators.claims import diagnosis_claims
from claims_cohorts.operators.memberfilter import BUCKETS, member_bitmaps, of_members
from claims_cohorts.operators.temporal import clean_period, exclude_within_window
from claims_cohorts.sources.store import MOST_BUCKETS, buckets_for, write_claim_store
from claims_cohorts.sources.tables import balanced_predicates, load_jdbc
from claims_cohorts.sources.testdata import testdata_tables
from tests.helpers import events, index

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_joins_without_exchange(spark):
    t = testdata_tables(spark, SF)
    base = tempfile.mkdtemp(prefix="store-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sql(f"CREATE DATABASE claim_store_test LOCATION 'file://{base}'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_claim_store(spark, t, "claim_store_test", 2)
        stored = write_claim_store(spark, t, "claim_store_test", 4)  # overwrites
        plan = physical(diagnosis_claims(stored))
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert "Exchange" in physical(diagnosis_claims(t))
        for name, df in t.as_dict().items():
            assert stored.as_dict()[name].exceptAll(df).isEmpty() and df.exceptAll(stored.as_dict()[name]).isEmpty()
        rows = lambda x: sorted(map(str, diagnosis_claims(x).collect()))
        assert rows(stored) == rows(t)
        files = [f for f in stored.entries.inputFiles()]
        assert len(files) <= 4  # one file a bucket
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE claim_store_test CASCADE")
    with pytest.raises(ValueError):
        write_claim_store(spark, t, "x", MOST_BUCKETS + 1)


def test_bucket_numbers():
    assert [buckets_for(n) for n in (0, 1, 256 << 20, (256 << 20) + 1, 1 << 40)] == [1, 1, 1, 2, 4096]
    assert buckets_for(1 << 60) <= MOST_BUCKETS


def test_balanced_predicates_cut_a_skewed_range(spark):
    ids = [*range(100), 10**9, *range(10**12, 10**12 + 20), None, None]
    df = spark.createDataFrame([(i,) for i in ids], "claim_entry_id long")
    df.createOrReplaceTempView("skewed_ids")
    try:
        firsts = spark.sql("SELECT part, min(id) AS f FROM (SELECT claim_entry_id AS id, ntile(8) OVER (ORDER BY claim_entry_id) AS part FROM skewed_ids WHERE claim_entry_id IS NOT NULL) GROUP BY part")
        preds = balanced_predicates("claim_entry_id", [r["f"] for r in firsts.collect() if r["part"] > 1])
        sizes = [df.where(p).count() for p in preds]
    finally:
        spark.catalog.dropTempView("skewed_ids")
    assert sum(sizes) == len(ids) and len(sizes) == 8 and max(sizes) <= 18
    assert df.where(balanced_predicates("claim_entry_id", [])[0]).count() == len(ids)
    assert len(balanced_predicates("x", [5, 5, 5])) == 2  # a hot id is one task's


class Reader:
    """Stands for a database: answers the questions for names and cuts, and keeps what is read."""

    def __init__(self, spark, tables, log, opts=None):
        self.spark, self.tables, self.log, self.opts = spark, tables, log, opts or {}

    def format(self, kind):
        return Reader(self.spark, self.tables, self.log)

    def option(self, key, value):
        return Reader(self.spark, self.tables, self.log, {**self.opts, key: value})

    def load(self):
        table = self.opts["dbtable"]
        if "information_schema" in table:
            return self.spark.createDataFrame([(t,) for t in self.tables], "table_name string")
        if "ntile" in table:
            name = table.split(" FROM ")[2].split(" ")[0].split(".")[1]
            n = int(table.split("ntile(")[1].split(")")[0])
            ids = sorted(r[0] for r in self.tables[name].select("claim_entry_id").collect())
            cuts = [(k + 1, ids[len(ids) * k // n]) for k in range(n)] if ids else []
            return self.spark.createDataFrame(cuts, "part int, first_id long")
        return self.tables[table.split(".")[1]]

    def jdbc(self, url, table, predicates, properties):
        self.log.append((table, predicates, properties))
        df = self.tables[table.split(".")[1]]
        out = df.where(predicates[0])
        for p in predicates[1:]:
            out = out.unionByName(df.where(p))
        return out


def test_balanced_jdbc_read(spark):
    t = testdata_tables(spark, SF).as_dict()
    t["claims_drugs"] = t["claims_drugs"].limit(0)
    stub = type("Session", (), {})()
    stub.read = Reader(spark, t, [])
    loaded = load_jdbc(stub, "jdbc:postgresql://h/db", "prod", {"user": "u"}, 5, balanced=True)
    read = {table: (predicates, properties) for table, predicates, properties in stub.read.log}
    assert set(read) == {f"prod.{n}" for n in ("claims_entries", "claims_diagnoses", "claims_procedures", "claims_drugs")}
    assert all(p[1] == {"user": "u"} for p in read.values()) and len(read["prod.claims_drugs"][0]) == 1
    sizes = [t["claims_entries"].where(p).count() for p in read["prod.claims_entries"][0]]
    assert len(sizes) == 5 and max(sizes) <= min(sizes) + 2
    assert loaded.entries.count() == t["claims_entries"].count() and loaded.members is not None


def test_member_filter_has_a_fixed_size_and_no_false_negative(spark):
    members = spark.range(40_000).select(F.concat(F.lit("m"), "id").alias("member_id_hash"))
    bitmaps = member_bitmaps(members.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS member_id_hash")))
    sizes = bitmaps.selectExpr("count(*) AS n", "max(length(_bits)) AS bytes").first()
    assert sizes["n"] <= BUCKETS and sizes["bytes"] == 4096
    all_events = spark.range(400_000).select(F.concat(F.lit("m"), "id").alias("member_id_hash"), F.lit("2020-01-01").cast("date").alias("date_of_service"))
    kept = of_members(all_events, members)
    assert kept.join(members, "member_id_hash", "left_semi").count() == 40_000
    assert kept.count() < 42_000  # 40,000 of 16.8 million bits are set
    assert of_members(all_events, members.limit(0)).count() == 0


def test_only_events_of_index_members_are_shuffled(spark):
    ev = events(spark, [("a", "2020-01-10"), (None, "2020-01-10"), ("b", None)] + [(f"x{k}", "2020-01-10") for k in range(500)])
    idx = index(spark, [("a", "2020-01-01"), ("b", "2020-01-01"), (None, "2020-01-01")])
    out = exclude_within_window(idx, ev, 30, prefilter=True)
    assert sorted(map(str, out.collect())) == sorted(map(str, idx.where("member_id_hash = 'b' or member_id_hash is null").collect()))
    plan = physical(clean_period(idx, ev))
    below = plan[plan.index("Window") :]
    assert "BroadcastHashJoin" in below and "bitmap_construct_agg" in below
