from claims_cohorts.operators.members import add_member_info
from claims_cohorts.operators.tags import member_tags
from tests.helpers import D, as_set, claims_tables, index


def test_left_join_keeps_unmatched_and_fans_out(spark):
    idx = index(spark, [("a", "2023-01-01"), ("b", "2023-01-01")])
    members = spark.createDataFrame([("a", "Ann"), ("a", "Ann2"), ("c", "Cy")], "member_id_hash string, member_name string")
    out = add_member_info(idx, members)
    assert out.columns == ["member_id_hash", "index_date", "member_name"]
    assert sorted(out.collect(), key=lambda r: (r[0], r[2] or "")) == sorted(
        [("a", D("2023-01-01"), "Ann"), ("a", D("2023-01-01"), "Ann2"), ("b", D("2023-01-01"), None)], key=lambda r: (r[0], r[2] or "")
    )


def test_empty_index_keeps_schema(spark):
    idx = index(spark, [])
    members = spark.createDataFrame([("a", "Ann")], "member_id_hash string, member_name string")
    out = add_member_info(idx, members)
    assert out.count() == 0 and out.columns == ["member_id_hash", "index_date", "member_name"]


def test_tags_any_date_any_type(spark):
    t = claims_tables(
        spark,
        [(1, "a", "2010-01-01", "pharma"), (2, "b", "2023-01-01", "medical")],
        [(1, "I15.0"), (2, "I119")],
    )
    idx = index(spark, [("a", "2023-01-01"), ("b", "2023-01-01"), ("c", "2023-01-01")])
    out = member_tags(idx, t, {"secondary_htn": ["I15.*"], "htn_complication": ["I11.*", "I12.*"]})
    assert as_set(out, "member_id_hash", "secondary_htn", "htn_complication") == {
        ("a", True, False), ("b", False, True), ("c", False, False)
    }
