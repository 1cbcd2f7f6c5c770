"""Plan checks: no Python in the data path, no cartesian products, pushdown reaches scans."""

import pytest

from claims_cohorts.plans import queries as Q

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(Q.all_queries()))
def test_no_python_or_cartesian(spark, name):
    plan = physical(Q.all_queries()[name](spark, SF))
    for node in FORBIDDEN:
        assert node not in plan, f"{name}: {node}"


def test_building_a_query_starts_no_job(spark):
    """Every query is lazy, so the plans inspected here are whole."""
    Q.tables(spark, SF)  # the one step that reads: Parquet footers, for the schemas
    sc = spark.sparkContext
    tracker = sc.statusTracker()
    for name, build in Q.all_queries().items():
        sc.setJobGroup(f"build-{name}", name)
        try:
            build(spark, SF)
            jobs = tracker.getJobIdsForGroup(f"build-{name}")
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert list(jobs) == [], name


def test_code_filter_is_pushed_to_the_scan(spark, parquet_tables):
    from claims_cohorts.operators.claims import code_claims

    plan = physical(code_claims(parquet_tables, ["K58.0"], ["medical"]))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert any("EqualTo(icd_code,K58.0)" in s or "In(icd_code" in s for s in scans)
    assert any("EqualTo(claim_type,medical)" in s for s in scans)


def test_inner_wildcards_need_no_nested_loop(spark, parquet_tables):
    from claims_cohorts.plans.cohorts import build_cohorts
    from claims_cohorts.plans.spec import config_from_text

    rule = "    inclusion:\n      icd_codes: ['K*8', 'I1*.9', 'E*']\n      min_claims: 2\n    exclusion:\n      subtypes: ['*1']\n      subtype_window_days: 30\n"
    cfg = config_from_text("cohorts:\n  A:\n" + rule + "  B:\n" + rule)
    plan = physical(build_cohorts(parquet_tables, cfg, as_of="2001-08-01"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _fact_scans(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and any(c in line for c in ("l_orderkey", "o_orderkey")) for line in plan.splitlines())


@pytest.mark.parametrize(
    "name, most",
    [("symptom_flag", 2), ("lookback_exclusion", 2), ("within_months", 2), ("member_info", 2), ("exclude_window_subtype", 4), ("exclude_window_organic", 4)],
)
def test_fact_scans(spark, name, most):
    assert _fact_scans(Q.all_queries()[name](spark, SF)) <= most


@pytest.fixture(scope="module")
def parquet_tables(spark):
    """The derived claims tables written as real Parquet tables, loaded back."""
    import tempfile

    from claims_cohorts.sources.tables import load_parquet_dir
    from claims_cohorts.sources.testdata import testdata_tables

    base = tempfile.mkdtemp(prefix="claims-parquet-", dir="/tmp")
    for name, df in testdata_tables(spark, SF).as_dict().items():
        df.write.mode("overwrite").parquet(f"{base}/{name}.parquet")
    return load_parquet_dir(spark, base)


def test_code_predicates_reach_parquet(spark, parquet_tables):
    from claims_cohorts.operators.lines import LineRule, claim_lines
    from claims_cohorts.plans.cohorts import build_cohort
    from claims_cohorts.plans.spec import load_config

    rules = [LineRule("IBS_D", "inclusion", "icd", ("K58.0",), ("medical",)), LineRule("IBS_D", "subtypes", "icd", ("K58.1*",))]
    plan = physical(claim_lines(parquet_tables, rules, "2001-08-01"))
    scan = [line for line in plan.splitlines() if "claims_diagnoses" in line or "icd_code:string" in line]
    assert any("In(icd_code" in line or "EqualTo(icd_code" in line for line in scan), scan
    assert any("StringStartsWith(icd_code,K58.1)" in line for line in scan), scan
    assert any("ReadSchema: struct<claim_entry_id:bigint,icd_code:string>" in line for line in scan), scan
    htn = build_cohort(parquet_tables, load_config(), "HTN_Conservative", as_of="2001-08-01", with_members=False)
    assert "StringStartsWith(icd_code,I11" in physical(htn)


def test_common_limits_reach_the_entries_scan(spark, parquet_tables):
    from claims_cohorts.operators.lines import LineRule, claim_lines
    from claims_cohorts.plans.cohorts import build_cohort
    from claims_cohorts.plans.spec import load_config

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")

    def entry_scan(df):
        return next(line for line in physical(df).splitlines() if "FileScan" in line and "date_of_service" in line)

    plan = lambda name: build_cohort(parquet_tables, load_config(), name, "2001-08-01", with_members=False)
    assert "GreaterThanOrEqual(date_of_service,1996-08-01)" in entry_scan(plan("IBS_General"))
    assert "claim_type,medical" in entry_scan(plan("HTN_Conservative"))
    limited = LineRule("c", "inclusion", "icd", ("I10",), ("medical",), 5)
    older = LineRule("c", "lookback", "icd", ("I11",), ("pharma",), 8)
    both = entry_scan(claim_lines(parquet_tables, [limited, older], "2001-08-01"))
    assert "1993-08-01" in both and "In(claim_type" in both
    free = entry_scan(claim_lines(parquet_tables, [limited, LineRule("c", "ever", "icd", ("I12",))], "2001-08-01"))
    assert "GreaterThanOrEqual" not in free and "claim_type," not in free.split("PushedFilters")[1].split("]")[0].replace("IsNotNull", "")


def test_parquet_source_gives_same_cohorts(spark, parquet_tables):
    from claims_cohorts.plans.cohorts import build_cohorts
    from claims_cohorts.plans.spec import load_config
    from claims_cohorts.sources.testdata import testdata_tables

    cfg = load_config()
    a = build_cohorts(parquet_tables, cfg, as_of="2001-08-01")
    b = build_cohorts(testdata_tables(spark, SF), cfg, as_of="2001-08-01")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_index_pass_shuffle_shape(spark):
    """The 18-cohort index pass: entries and the unioned claim lines shuffled once each
    by claim_entry_id, one compaction shuffle, one (cohort, member) shuffle — nothing
    else besides the codebook's join on the code, which stays a broadcast unless
    broadcasts are off, as here (cluster-sized inputs)."""
    import re
    from collections import Counter

    from claims_cohorts.plans.cohorts import build_cohorts

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = build_cohorts(Q.tables(spark, SF), Q.config(), None, Q.AS_OF, with_members=False)
        plan = physical(df)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    keys = Counter(re.sub(r"#\d+L?|, \d+$", "", m) for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan))
    assert keys == Counter(
        {"icd_code": 2, "claim_entry_id": 2, "cohort, role, member_id_hash, date_of_service": 1, "cohort, member_id_hash": 1}
    ), keys
    assert plan.count("Window [") == 2
