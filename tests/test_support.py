from claims_cohorts.operators.support import (
    combine_support,
    drug_support,
    drug_support_window,
    procedure_support,
    procedure_support_window,
    support_flags,
)
from claims_cohorts.plans.spec import config_from_text, default_path_spec
from tests.helpers import as_set, claims_tables, index

ENTRIES = [
    (1, "a", "2023-01-01", "medical"),
    (2, "b", "2023-01-01", "medical"),
    (3, "c", "2023-05-01", "pharma"),
    (4, "d", "2023-05-01", "medical"),
    (5, "e", "2023-05-01", "pharma"),
    (6, "f", "2023-05-01", "pharma"),
]
PROCS = [(1, "33510"), (2, "0000000"), (4, "92960")]
DRUGS = [(3, "LISINOPRIL"), (4, "LISINOPRIL"), (5, ""), (6, None)]


def mem(df):
    return {r.member_id_hash for r in df.collect()}


def tables(spark):
    return claims_tables(spark, ENTRIES, [], PROCS, DRUGS)


def test_procedure_support_ever_skips_sentinel(spark):
    t = tables(spark)
    idx = index(spark, [(m, "2023-06-01") for m in "abcdef"])
    assert mem(procedure_support(idx, t, ["33510", "92960", "0000000"])) == {"a", "d"}
    assert mem(procedure_support(idx, t, [])) == set()


def test_drug_support_pharma_only_no_blank_names(spark):
    t = tables(spark)
    idx = index(spark, [(m, "2023-06-01") for m in "abcdef"])
    assert mem(drug_support(idx, t, ["LISINOPRIL", "%"])) == {"c"}


def test_support_windows_inclusive(spark):
    t = tables(spark)
    idx = index(spark, [("a", "2023-06-30"), ("d", "2023-05-01"), ("c", "2023-10-29"), ("c", "2023-04-30")])
    # a: 180 days after its procedure (inside); d: same day (inside)
    assert mem(procedure_support_window(idx, t, ["33510", "92960"], 180)) == {"a", "d"}
    # c: 181 days after (outside), and one day before the fill (outside)
    assert mem(drug_support_window(idx, t, ["LISINOPRIL"], 180)) == set()


def test_flags_and_combination(spark):
    t = tables(spark)
    idx = index(spark, [(m, "2023-06-01") for m in "abcd"])
    flags = support_flags(idx, t, ["33510", "92960"], ["LISINOPRIL"])
    assert as_set(flags, "member_id_hash", "has_procedure_support", "has_drug_support") == {
        ("a", True, False), ("b", False, False), ("c", False, True), ("d", True, False)
    }
    assert mem(combine_support(flags, "and")) == set()
    assert mem(combine_support(flags, "or")) == {"a", "c", "d"}
    empty = support_flags(idx, t, [], [])
    assert {r.has_procedure_support for r in empty.collect()} == {False}


def _mode(text):
    cfg = config_from_text(text)
    return default_path_spec(cfg, "X").support_mode


BASE = "cohorts:\n  X:\n    inclusion:\n      icd_codes: ['A']\n      min_claims: 2\n"


def test_support_modes():
    both = BASE + "      allow_procedure: true\n      procedure_codes: ['1']\n      allow_medication: true\n      medication_codes: ['D']\n"
    assert _mode(both) == "and"
    assert _mode(both + "      require_both_procedure_and_medication: false\n") == "or"
    proc_only = BASE + "      allow_procedure: true\n      procedure_codes: ['1']\n      require_both_procedure_and_medication: false\n"
    assert _mode(proc_only) == "none"
    drug_only = BASE + "      allow_medication: true\n      medication_codes: ['D']\n      require_both_procedure_and_medication: false\n"
    assert _mode(drug_only) == "drug"
    assert _mode(BASE + "      allow_procedure: true\n      procedure_codes: ['1']\n") == "proc"
    assert _mode(BASE + "      procedure_codes: ['1']\n") == "none"
