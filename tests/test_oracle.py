"""Every registered query that has a DuckDB oracle against it, on the smallest test tables."""

import __spark_entry__ as E

from claims_cohorts.plans import queries
from tests.compare import compare

SF = "/root/testdata/sf0.001"


def test_every_cohort_query_has_an_oracle():
    assert set(queries.all_queries()) <= set(E.oracle_sql())


def test_all_queries_match_oracle(spark):
    res = compare(spark, SF, names=sorted(E.oracle_sql()), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] is not True}
    assert not bad, bad


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "member_id_hash" and df.columns[-1] == "cohort"
    assert df.count() > 0
