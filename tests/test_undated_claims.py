"""Claims without a date: they order nothing, but count where any date does."""

from claims_cohorts.plans.cohorts import CohortContext, build_cohorts
from claims_cohorts.plans.spec import config_from_text, load_config
from claims_cohorts.plans.strategies import STRATEGIES
from tests.helpers import as_set, claims_tables

PAIR = ("2022-01-01", "2022-03-01")


def pairs(members, code, start=0, types=("medical", "medical")):
    """Two claims of each member, 59 days apart, with the code."""
    entries, dx = [], []
    for k, m in enumerate(members):
        for j, day in enumerate(PAIR):
            i = start + 2 * k + j
            entries.append((i, m, day, types[j]))
            dx.append((i, code))
    return entries, dx


def members_of(df):
    return {r["member_id_hash"] for r in df.collect()}


def strategy(spark, cohort, kind, code, excluding):
    cfg = load_config()
    entries, dx = pairs(["dated", "undated", "clean"], code)
    entries += [(100, "dated", "2021-12-01", "medical"), (101, "undated", None, "medical"), (102, None, None, "medical")]
    dx += [(100, excluding), (101, excluding), (102, excluding)]
    t = claims_tables(spark, entries, dx)
    return members_of(STRATEGIES[kind](CohortContext(t, cfg, "2022-06-01"), cohort))


def test_undated_exclusion_counts(spark):
    cfg = load_config()
    first = lambda codes: codes[0].replace("*", "1")
    pcos = cfg.cohort("PCOS")
    assert strategy(spark, "PCOS", "pcos", first(pcos["inclusion"]["icd_codes"]), first(next(iter(pcos["exclusion"].values())))) == {"clean"}
    met = cfg.cohort("Metabolic_Syndrome")
    assert strategy(spark, "Metabolic_Syndrome", "metabolic", first(met["inclusion"]["icd_codes"]), first(met["exclusion"]["cancer"])) == {"clean"}
    pre = cfg.cohort("PreDiabetes")
    assert strategy(spark, "PreDiabetes", "diabetes", first(pre["inclusion"]["icd_codes"]), first(pre["exclusion"]["gdm_codes"])) == {"clean"}


def supported_tables(spark):
    entries, dx = pairs(["dated", "undated", "none"], "I25.1")
    entries += [(100, "dated", "2019-01-01", "medical"), (101, "undated", None, "medical")]
    entries += [(200, "dated", "2019-01-01", "pharma"), (201, "undated", None, "pharma")]
    return claims_tables(spark, entries, dx, procedures=[(100, "33510"), (101, "33510")], drugs=[(200, "STATIN"), (201, "STATIN")])


SUPPORTED = """
cohorts:
  Sup:
    inclusion:
      icd_codes: ['I25.*']
      claim_types: [medical]
      min_claims: 2
      min_days_between_claims: 30
      allow_procedure: true
      procedure_codes: ['33510']
      allow_medication: true
      medication_codes: ['STATIN']
"""


def test_undated_support_counts(spark):
    cfg = config_from_text(SUPPORTED)
    t = supported_tables(spark)
    assert members_of(build_cohorts(t, cfg, with_members=False)) == {"dated", "undated"}
    assert members_of(STRATEGIES["cardiometabolic"](CohortContext(t, cfg), "Sup")) == {"dated", "undated"}


def test_undated_inclusion_claims_make_no_pair(spark):
    cfg = config_from_text(SUPPORTED.split("      allow_procedure")[0])
    t = claims_tables(spark, [(1, "a", "2022-01-01", "medical"), (2, "a", None, "medical"), (3, "b", None, "medical"), (4, "b", None, "medical")], [(k, "I25.1") for k in (1, 2, 3, 4)])
    assert members_of(build_cohorts(t, cfg, with_members=False)) == set()


def test_repeated_name_repeats_rows_only(spark):
    cfg = config_from_text("cohorts:\n  Sens:\n    inclusion:\n      icd_codes: ['I10']\n      min_claims: 1\n")
    t = claims_tables(spark, [(1, "single", "2022-01-01", "medical"), (2, "pair", "2022-01-01", "medical"), (3, "pair", "2022-02-01", "medical")], [(k, "I10") for k in (1, 2, 3)])
    once = build_cohorts(t, cfg, ["Sens"], with_members=False)
    twice = build_cohorts(t, cfg, ["Sens", "Sens"], with_members=False)
    assert as_set(once, "member_id_hash") == {("pair",)} and as_set(twice) == as_set(once)
    assert twice.count() == 2 * once.count() and twice.columns == once.columns
