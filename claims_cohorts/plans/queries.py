"""Named queries over the test tables: one per operator and one per cohort.

Each takes ``(spark, sf_dir)``, derives the claims tables from the whole test tables
and returns a lazy DataFrame. Parameters follow the shipped cohort configuration.
"""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claims_cohorts.columns import CLAIM_ID, CLAIM_TYPE, DATE, DRUG, ICD, INDEX, MEMBER, PROC
from claims_cohorts.functions.codes import claim_type_match, date_range_filter, drug_match, icd_match, procedure_match
from claims_cohorts.functions.chapters import icd10_chapter
from claims_cohorts.functions.dates import DAYS_PER_UNIT, duration_days, parse_duration_days
from claims_cohorts.operators import eligibility as elig
from claims_cohorts.operators.claims import code_claims, diagnosis_claims
from claims_cohorts.operators.codebook import codebook
from claims_cohorts.operators.index import (
    component_window_index,
    first_claim_index,
    first_pair_index,
    rolling_claims_index,
    second_claim_index,
)
from claims_cohorts.operators.intervals import claim_episodes, index_in_episode
from claims_cohorts.operators.members import add_member_info
from claims_cohorts.operators.sameday import chapter_days, exclude_same_day_chapters
from claims_cohorts.operators.support import (
    combine_support,
    drug_support,
    drug_support_window,
    procedure_support,
    procedure_support_window,
    support_flags,
)
from claims_cohorts.operators.tags import member_tags
from claims_cohorts.operators.temporal import (
    clean_period,
    exclude_ever,
    exclude_on_or_before,
    exclude_within_window,
)
from claims_cohorts.operators.validation import claims_quality, output_quality
from claims_cohorts.plans import strategies as S
from claims_cohorts.plans.cohorts import CohortContext, build_cohort, build_cohorts, inclusion_claims_advanced, symptom_claims
from claims_cohorts.plans.run import STAMP_FORMAT, combined_summary, cohort_counts
from claims_cohorts.plans.spec import CohortConfig, load_config
from claims_cohorts.sources.tables import ClaimsTables, table_profile
from claims_cohorts.sources.testdata import AS_OF, coverage, testdata_tables

Query = Callable[[SparkSession, str], DataFrame]

# FIXED VALUES — probe parameters (code lists from the shipped configuration).
ICD_PROBE_CODES = ["K58.*", "R10.", "I10", "E78.0", "O24.4*", "C*", "Z68.3*"]
DRUG_PROBE_NAMES = ["LISINOPRIL", "ATORVASTATIN%", "ACETAMINOPHEN*"]
SUPPORT_WINDOW_DAYS = 180
CLEAN_PERIOD_DAYS = 365
ENROLLMENT_DAYS = 365
# Gap allowed in continuous enrollment, claims asked for in a rolling period, further
# same-day chapters (a chapter number, a range, a prefix), and the pregnancy episodes.
ENROLLMENT_GAP_DAYS = 45
ROLLING_CLAIMS = 3
SAME_DAY_CHAPTERS = [18, "I10-I15", "E78"]
EPISODE_GAP_DAYS = 120
EPISODE_BEFORE_DAYS = 90
EPISODE_AFTER_DAYS = 60


@lru_cache(maxsize=1)
def config() -> CohortConfig:
    return load_config()


_TABLES: dict[str, tuple[SparkSession, ClaimsTables]] = {}


def tables(spark: SparkSession, sf_dir: str) -> ClaimsTables:
    """Claims tables for ``sf_dir``, built once per session (lazy DataFrames, no data held).

    Reused only for the very same session object; a new session rebuilds them.
    """
    cached = _TABLES.get(sf_dir)
    if cached is None or cached[0] is not spark:
        cached = (spark, testdata_tables(spark, sf_dir))
        _TABLES[sf_dir] = cached
    return cached[1]


def ctx(spark: SparkSession, sf_dir: str) -> CohortContext:
    return CohortContext(tables(spark, sf_dir), config(), AS_OF)


def _inc(name: str) -> dict:
    return config().inclusion(name)


def _exc(name: str) -> dict:
    return config().exclusion(name)


def htn_index(t: ClaimsTables) -> DataFrame:
    inc = _inc("HTN_Conservative")
    return first_pair_index(code_claims(t, inc["icd_codes"], inc["claim_types"]), inc["min_days_between_claims"])


def ibs_d_index(t: ClaimsTables) -> DataFrame:
    inc = _inc("IBS_D")
    claims = code_claims(t, inc["icd_codes"], inc["claim_types"])
    return first_pair_index(claims, inc["min_days_between_claims"], within_days=inc["within_months"] * 30, span_min_claims=inc["min_claims"])


def prediabetes_second(t: ClaimsTables) -> DataFrame:
    inc = _inc("PreDiabetes")
    return second_claim_index(code_claims(t, inc["icd_codes"], inc["claim_types"]), 30, 2)


def cad_index(t: ClaimsTables) -> DataFrame:
    inc = _inc("CAD_Conservative")
    return first_pair_index(code_claims(t, inc["icd_codes"], inc["claim_types"]), inc["min_days_between_claims"])


# --- sources, sinks, validation ---------------------------------------------------------


def q_load_claims_tables(spark, sf_dir):
    return tables(spark, sf_dir).entries_typed()


def q_inclusion_claims(spark, sf_dir):
    inc = _inc("IBS_General")
    return code_claims(tables(spark, sf_dir), inc["icd_codes"], inc.get("claim_types"), inc["date_range_years"], AS_OF)


def q_inclusion_claims_advanced(spark, sf_dir):
    return inclusion_claims_advanced(tables(spark, sf_dir), _inc("CAD_Conservative"), AS_OF)


def q_table_profile(spark, sf_dir):
    prof = table_profile(spark, tables(spark, sf_dir))
    return prof.select(
        "table_name", "required", "present",
        F.array_join("missing_columns", ",").alias("missing_columns"), "n_columns", "row_count",
    )


def q_cohort_rules(spark, sf_dir):
    """(cohort, role, icd_code): which distinct codes in the data each configured rule matches."""
    rows = []
    for name in config().names():
        cfg = config().cohort(name)
        inc = cfg["inclusion"]
        lists = {"inclusion": inc["icd_codes"]}
        if "symptom_codes" in inc:
            lists["symptom_codes"] = inc["symptom_codes"]
        for label, comp in (inc.get("components") or {}).items():
            lists[f"component:{label}"] = comp
        for key, value in (cfg.get("exclusion") or {}).items():
            if isinstance(value, list):
                lists[f"exclusion:{key}"] = value
        for key, value in (cfg.get("tags") or {}).items():
            lists[f"tag:{key}"] = value
        for role, code_list in lists.items():
            if code_list:
                rows.append((name, role, code_list))
    return codebook(tables(spark, sf_dir).diagnoses, rows)


def combined(spark, sf_dir) -> DataFrame:
    return build_cohorts(tables(spark, sf_dir), config(), None, AS_OF)


def q_combined_cohorts(spark, sf_dir):
    return combined(spark, sf_dir)


def q_cohort_metadata(spark, sf_dir):
    return cohort_counts(combined(spark, sf_dir))


def q_combined_metadata(spark, sf_dir):
    """The whole metadata document in one row; its lists and counts as text, its time the as-of date."""
    row = combined_summary(combined(spark, sf_dir), config().names(), datetime.fromisoformat(AS_OF).strftime(STAMP_FORMAT))
    counts = F.transform("cohorts", lambda c: F.concat_ws("=", c, F.col("cohort_counts")[c].cast("string")))
    return row.select(
        "total_rows", "n_cohorts", "earliest_index_date", "latest_index_date",
        F.array_join("cohorts", ",").alias("cohorts"),
        F.array_join(counts, ",").alias("cohort_counts"),
        "timestamp",
        F.array_join("columns", ",").alias("columns"),
    )


def q_claims_quality(spark, sf_dir):
    return claims_quality(spark, diagnosis_claims(tables(spark, sf_dir)))


def q_output_quality(spark, sf_dir):
    return output_quality(spark, build_cohort(tables(spark, sf_dir), config(), "HTN_Conservative", AS_OF))


# --- predicates ------------------------------------------------------------------


def q_icd_filter(spark, sf_dir):
    return tables(spark, sf_dir).diagnoses.where(icd_match(ICD_PROBE_CODES, ICD)).select(CLAIM_ID, ICD)


def q_procedure_filter(spark, sf_dir):
    codes = _inc("CAD_Conservative")["procedure_codes"]
    return tables(spark, sf_dir).procedures.where(procedure_match(codes, PROC)).select(CLAIM_ID, PROC)


def q_drug_filter(spark, sf_dir):
    return tables(spark, sf_dir).drugs.where(drug_match(DRUG_PROBE_NAMES, DRUG)).select(CLAIM_ID, DRUG)


def q_claim_type_filter(spark, sf_dir):
    return tables(spark, sf_dir).entries_typed().where(claim_type_match(["pharma"], CLAIM_TYPE))


def q_date_range_filter(spark, sf_dir):
    years = _inc("IBS_General")["date_range_years"]
    return tables(spark, sf_dir).entries_typed().where(date_range_filter(years, AS_OF, DATE))


# --- joins and temporal filters ---------------------------------------------------------


def q_symptom_flag(spark, sf_dir):
    inc = _inc("IBS_D")
    return symptom_claims(tables(spark, sf_dir), inc["icd_codes"], inc["symptom_codes"], inc["symptom_window_days"], inc["claim_types"])


def q_exclude_window_subtype(spark, sf_dir):
    t = tables(spark, sf_dir)
    exc = _exc("IBS_D")
    return exclude_within_window(ibs_d_index(t), code_claims(t, exc["subtypes"]), exc["subtype_window_days"])


def q_exclude_window_organic(spark, sf_dir):
    t = tables(spark, sf_dir)
    exc = _exc("IBS_D")
    return exclude_within_window(ibs_d_index(t), code_claims(t, exc["organic_gi"]), exc["organic_gi_window_days"])


def q_lookback_exclusion(spark, sf_dir):
    return S.diabetes_inclusion_claims(ctx(spark, sf_dir), "PreDiabetes")


def q_exclude_on_or_before(spark, sf_dir):
    t = tables(spark, sf_dir)
    return exclude_on_or_before(prediabetes_second(t), code_claims(t, _exc("PreDiabetes")["diabetes_codes"]))


def q_exclude_ever(spark, sf_dir):
    t = tables(spark, sf_dir)
    return exclude_ever(prediabetes_second(t), code_claims(t, _exc("PreDiabetes")["gdm_codes"]))


def q_procedure_support(spark, sf_dir):
    t = tables(spark, sf_dir)
    return procedure_support(htn_index(t), t, _inc("CAD_Conservative")["procedure_codes"])


def q_drug_support(spark, sf_dir):
    t = tables(spark, sf_dir)
    return drug_support(htn_index(t), t, _inc("CAD_Conservative")["medication_codes"])


def q_procedure_support_window(spark, sf_dir):
    t = tables(spark, sf_dir)
    return procedure_support_window(htn_index(t), t, _inc("CAD_Conservative")["procedure_codes"], SUPPORT_WINDOW_DAYS)


def q_drug_support_window(spark, sf_dir):
    t = tables(spark, sf_dir)
    return drug_support_window(htn_index(t), t, _inc("CAD_Conservative")["medication_codes"], SUPPORT_WINDOW_DAYS)


def q_procedure_flag(spark, sf_dir):
    t = tables(spark, sf_dir)
    return support_flags(htn_index(t), t, procedure_codes=_inc("CAD_Conservative")["procedure_codes"])


def q_drug_flag(spark, sf_dir):
    t = tables(spark, sf_dir)
    return support_flags(htn_index(t), t, drug_names=_inc("CAD_Conservative")["medication_codes"])


def _cad_support(spark, sf_dir, mode):
    t = tables(spark, sf_dir)
    inc = _inc("CAD_Conservative")
    flags = support_flags(cad_index(t), t, inc["procedure_codes"], inc["medication_codes"])
    return combine_support(flags, mode).drop("has_procedure_support", "has_drug_support")


def q_support_and(spark, sf_dir):
    return _cad_support(spark, sf_dir, "and")


def q_support_or(spark, sf_dir):
    return _cad_support(spark, sf_dir, "or")


def q_member_info(spark, sf_dir):
    t = tables(spark, sf_dir)
    return add_member_info(htn_index(t), t.members)


def q_member_tags(spark, sf_dir):
    t = tables(spark, sf_dir)
    return member_tags(htn_index(t), t, config().tags("HTN_Conservative"))


def q_clean_period(spark, sf_dir):
    t = tables(spark, sf_dir)
    # any claim entry counts, with or without a diagnosis line
    return clean_period(htn_index(t), t.entries_typed(), CLEAN_PERIOD_DAYS)


def q_enrollment_filter(spark, sf_dir):
    t = tables(spark, sf_dir)
    return elig.enrollment_filter(htn_index(t), t.eligibility, ENROLLMENT_DAYS, ENROLLMENT_DAYS)


def q_enrollment_spans(spark, sf_dir):
    return elig.enrollment_spans(coverage(tables(spark, sf_dir).entries), ENROLLMENT_GAP_DAYS)


def q_continuous_enrollment(spark, sf_dir):
    t, inc = tables(spark, sf_dir), _inc("IBS_General")
    back, ahead = parse_duration_days(inc["look_back_enrollment"]), parse_duration_days(inc["look_ahead_enrollment"])
    return elig.continuous_enrollment(htn_index(t), coverage(t.entries), back, ahead, ENROLLMENT_GAP_DAYS)


def q_code_chapters(spark, sf_dir):
    """ICD-10-CM chapter of every distinct code (null: none)."""
    return tables(spark, sf_dir).diagnoses.select(ICD).distinct().withColumn("chapter", icd10_chapter(ICD))


def q_chapter_days(spark, sf_dir):
    return chapter_days(diagnosis_claims(tables(spark, sf_dir)))


def q_same_day_chapters(spark, sf_dir):
    t, chapters = tables(spark, sf_dir), [*_exc("IBS_General")["same_day_exclusion_chapters"], *SAME_DAY_CHAPTERS]
    claims = code_claims(t, _inc("IBS_General")["icd_codes"])
    return exclude_same_day_chapters(claims, diagnosis_claims(t), chapters)


def _pregnancies(t: ClaimsTables) -> DataFrame:
    return claim_episodes(code_claims(t, _exc("Metabolic_Syndrome")["pregnancy"]), EPISODE_GAP_DAYS)


def q_pregnancy_episodes(spark, sf_dir):
    return _pregnancies(tables(spark, sf_dir))


def q_index_in_episode(spark, sf_dir):
    t = tables(spark, sf_dir)
    return index_in_episode(htn_index(t), _pregnancies(t), EPISODE_BEFORE_DAYS, EPISODE_AFTER_DAYS)


# --- index finders and aggregates ----------------------------------------------------


def q_index_first_pair(spark, sf_dir):
    return htn_index(tables(spark, sf_dir))


def q_index_second_claim(spark, sf_dir):
    return prediabetes_second(tables(spark, sf_dir))


def q_index_first_claim(spark, sf_dir):
    inc = _inc("CAD_Sensitive")
    return first_claim_index(code_claims(tables(spark, sf_dir), inc["icd_codes"], inc["claim_types"]))


def q_within_months(spark, sf_dir):
    inc = _inc("Diabetes_General")
    claims = code_claims(tables(spark, sf_dir), inc["icd_codes"], inc["claim_types"])
    return first_pair_index(claims, inc["min_days_between_claims"], within_days=inc["within_months"] * 30, span_min_claims=inc["min_claims"])


def q_rolling_claims(spark, sf_dir):
    inc = _inc("Diabetes_General")
    claims = code_claims(tables(spark, sf_dir), inc["icd_codes"], inc["claim_types"])
    return rolling_claims_index(claims, ROLLING_CLAIMS, inc["within_months"] * 30)


def q_component_claims(spark, sf_dir):
    return S.component_claims(ctx(spark, sf_dir), _inc("Metabolic_Syndrome")["components"])


def q_component_window(spark, sf_dir):
    inc = _inc("Metabolic_Syndrome")
    comps = inc["components"]
    rows = S.component_claims(ctx(spark, sf_dir), comps)
    return component_window_index(rows, list(comps), inc["min_components"], inc["component_window_days"])


def q_metabolic_index_rows(spark, sf_dir):
    return S.metabolic_index_rows(ctx(spark, sf_dir), "Metabolic_Syndrome")


# --- scalars -----------------------------------------------------------------------


def q_duration_days(spark, sf_dir):
    """Members with a duration text derived from their key, in days (all units, many counts)."""
    key = F.col(MEMBER).cast("long")
    unit = F.element_at(F.array(*[F.lit(u) for u in DAYS_PER_UNIT]), (key % len(DAYS_PER_UNIT) + 1).cast("int"))
    text = F.concat((key % 31 + 1).cast("string"), unit)
    return tables(spark, sf_dir).members.select(MEMBER, text.alias("duration")).withColumn("days", duration_days("duration"))


def q_month_spine(spark, sf_dir):
    return elig.enrollment_months(tables(spark, sf_dir).eligibility, AS_OF)


# --- cohorts and strategies ---------------------------------------------------------


def cohort_query(name: str) -> Query:
    def run(spark, sf_dir):
        return build_cohort(tables(spark, sf_dir), config(), name, AS_OF)

    run.__name__ = f"cohort_{name}"
    return run


def q_combined_with_strategies(spark, sf_dir):
    """Default cohorts, family strategies and one custom cohort without member columns,
    from a private registry: columns that a cohort lacks are null."""
    registry = S.strategy_registry({"PreDiabetes": "diabetes", "CAD_Sensitive": "cardiometabolic"})

    def first_pharmacy_claim(c, name):
        pharmacy = c.tables.entries_typed().where(claim_type_match(["pharma"], CLAIM_TYPE))
        return first_claim_index(pharmacy).withColumn("cohort", F.lit(name))

    registry["First_Pharmacy"] = first_pharmacy_claim
    names = ["HTN_Conservative", "PreDiabetes", "CAD_Sensitive", "First_Pharmacy"]
    return build_cohorts(tables(spark, sf_dir), config(), names, AS_OF, registry=registry)


def strategy_query(strategy: str, cohort: str) -> Query:
    def run(spark, sf_dir):
        return S.STRATEGIES[strategy](ctx(spark, sf_dir), cohort)

    run.__name__ = f"{strategy}_{cohort}"
    return run


STRATEGY_QUERIES = {
    "prediabetes": ("diabetes", "PreDiabetes"),
    "diabetes_general": ("diabetes", "Diabetes_General"),
    "gdm": ("diabetes", "GDM"),
    "metabolic_syndrome": ("metabolic", "Metabolic_Syndrome"),
    "pcos": ("pcos", "PCOS"),
    "cardio_conservative": ("cardiometabolic", "CAD_Conservative"),
    "cardio_sensitive": ("cardiometabolic", "CAD_Sensitive"),
    "declared_ibs_general": ("declared", "IBS_General"),
    "declared_diabetes_general": ("declared", "Diabetes_General"),
    "declared_gdm": ("declared", "GDM"),
}


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name, fn in globals().items():
        if name.startswith("q_") and callable(fn):
            out[name[2:]] = fn
    for key, (strategy, cohort) in STRATEGY_QUERIES.items():
        out[key] = strategy_query(strategy, cohort)
    for name in config().names():
        out[f"cohort_{name}"] = cohort_query(name)
    return out
