"""Family strategies: alternative cohort logic offered by name, none registered by default.

Register one for a cohort with ``use_strategy("PreDiabetes", "diabetes")`` (or the
``cohort_logic`` decorator with your own function).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import COHORT, INDEX, MEMBER
from claims_cohorts.functions.codes import icd_match
from claims_cohorts.operators.claims import anchor_and_event_claims, code_claims, compact_claims, diagnosis_claims, tag_claims
from claims_cohorts.operators.lines import LineRule, claim_lines
from claims_cohorts.operators.temporal import EventWindow, flag_rows
from claims_cohorts.plans.cohorts import COHORT_LOGIC_REGISTRY, CohortContext, finish
from claims_cohorts.plans.declared import declared_strategy
from claims_cohorts.plans.member_pass import ANY_DATE_ROLES, metabolic_pass, strategy_pass

MEDICAL = ["medical"]
# FIXED VALUES — the cohorts whose names switch on special handling, and the
# exclusion keys each strategy reads.
LOOKBACK_COHORTS = ("PreDiabetes", "GDM")
DIABETES_GENERAL = "Diabetes_General"
DIABETES_GENERAL_EVER_KEYS = ("esrd_codes", "ckd5_codes", "htn_codes", "ckd_stages_1_4")
GDM_EVER_KEYS = ("pre_existing_diabetes", "o9981_code")
METABOLIC_EXCLUSION_KEYS = ("cushing", "t1dm", "pregnancy", "cancer", "hiv")
FIXED_GAP_DAYS = 30


def _ever_codes(exclusion: dict, keys: Sequence[str] | None) -> list[str]:
    chosen = exclusion if keys is None else [k for k in keys if k in exclusion]
    return [code for k in chosen for code in exclusion[k]]


def role_days(ctx: CohortContext, rules: Sequence[LineRule]) -> DataFrame:
    """(cohort, role, member, day, n_claims) for all of a strategy's rules from one
    claim-lines join."""
    rules = [r for r in rules if r.codes]
    lines = claim_lines(ctx.tables, rules, ctx.as_of)
    return compact_claims(lines, [COHORT, "role"], undated=F.col("role").isin(*ANY_DATE_ROLES))


def _finish(ctx: CohortContext, index: DataFrame, name: str) -> DataFrame:
    return finish(index.select(MEMBER, INDEX).withColumn(COHORT, F.lit(name)), ctx.tables)


def _types(inc: dict):
    return tuple(inc["claim_types"]) if "claim_types" in inc else None


# --- diabetes family ---------------------------------------------------------------


def diabetes_inclusion_claims(ctx: CohortContext, name: str) -> DataFrame:
    """Claim rows (member, date, code, type): code + claim-type rows (no date range);
    PreDiabetes/GDM drop rows with a diabetes claim (Diabetes_General's codes) in the
    preceding months."""
    inc = ctx.config.inclusion(name)
    if name not in LOOKBACK_COHORTS or "lookback_no_diabetes" not in inc:
        return code_claims(ctx.tables, inc["icd_codes"], inc.get("claim_types"))
    dm_codes = ctx.config.inclusion(DIABETES_GENERAL)["icd_codes"]
    rows = anchor_and_event_claims(ctx.tables, inc["icd_codes"], dm_codes, inc.get("claim_types"))
    before = EventWindow.lookback_months(int(inc["lookback_no_diabetes"]))
    rows = flag_rows(rows, F.col("_event"), before, "_diabetes")
    return rows.where("_anchor and not _diabetes").drop("_anchor", "_event", "_diabetes")


def diabetes_strategy(ctx: CohortContext, name: str) -> DataFrame:
    """Inclusion claims (minus days with a diabetes claim in the preceding months, for
    PreDiabetes/GDM) → later day of the first 30-day pair (PreDiabetes) or first pair
    → on-or-before and "ever" exclusions."""
    inc, exc = ctx.config.inclusion(name), ctx.config.exclusion(name)
    lookback = name in LOOKBACK_COHORTS and "lookback_no_diabetes" in inc
    ever = _ever_codes(exc, ["gdm_codes"])
    if name == DIABETES_GENERAL:
        ever += _ever_codes(exc, DIABETES_GENERAL_EVER_KEYS)
    if name == "GDM":
        ever += _ever_codes(exc, GDM_EVER_KEYS)
    on_or_before = name == "PreDiabetes" and "diabetes_codes" in exc
    rules = [LineRule(name, "inclusion", "icd", tuple(inc["icd_codes"]), _types(inc))]
    if lookback:
        rules.append(LineRule(name, "lookback", "icd", tuple(ctx.config.inclusion(DIABETES_GENERAL)["icd_codes"])))
    if on_or_before:
        rules.append(LineRule(name, "on_or_before", "icd", tuple(exc["diabetes_codes"])))
    if ever:
        rules.append(LineRule(name, "ever", "icd", tuple(ever)))
    if name == "PreDiabetes":
        kind, min_days = "second_claim", FIXED_GAP_DAYS
    else:
        kind, min_days = "first_pair", int(inc.get("min_days_between_claims", 30))
    index = strategy_pass(
        role_days(ctx, rules),
        kind,
        min_days,
        2,
        lookback_months=int(inc["lookback_no_diabetes"]) if lookback else None,
        on_or_before=on_or_before,
        ever=bool(ever),
    )
    return _finish(ctx, index, name)


# --- metabolic syndrome ------------------------------------------------------------


def component_claims(ctx: CohortContext, components: dict[str, Sequence[str]]) -> DataFrame:
    """Medical claim rows labelled with each component whose codes they match (one scan;
    a code in two components yields a row for each)."""
    all_codes = [c for codes in components.values() for c in codes]
    claims = diagnosis_claims(ctx.tables, icd_match(all_codes), F.col("claim_type").isin(MEDICAL))
    rules = [({"component": label}, icd_match(codes)) for label, codes in components.items()]
    return tag_claims(claims, rules)


def _metabolic_rules(name: str, inc: dict) -> list[LineRule]:
    rules = [LineRule(name, "strict", "icd", tuple(inc["icd_codes"]), tuple(MEDICAL))]
    for label, codes in inc["components"].items():
        rules.append(LineRule(name, f"component:{label}", "icd", tuple(codes), tuple(MEDICAL)))
    return rules


def _metabolic(ctx: CohortContext, name: str, with_exclusions: bool) -> DataFrame:
    inc, exc = ctx.config.inclusion(name), ctx.config.exclusion(name)
    rules = _metabolic_rules(name, inc)
    ever = _ever_codes(exc, METABOLIC_EXCLUSION_KEYS) if with_exclusions else []
    if ever:
        rules.append(LineRule(name, "ever", "icd", tuple(ever)))
    return metabolic_pass(
        role_days(ctx, rules),
        list(inc["components"]),
        int(inc["min_components"]),
        int(inc["component_window_days"]),
        FIXED_GAP_DAYS,
        ever=bool(ever),
    )


def metabolic_index_rows(ctx: CohortContext, name: str) -> DataFrame:
    """Strict (code pair, later date) rows UNION ALL broad (component window) rows."""
    return _metabolic(ctx, name, with_exclusions=False).select(MEMBER, INDEX)


def metabolic_strategy(ctx: CohortContext, name: str) -> DataFrame:
    return _finish(ctx, _metabolic(ctx, name, with_exclusions=True), name)


# --- PCOS -----------------------------------------------------------------------------


def pcos_strategy(ctx: CohortContext, name: str) -> DataFrame:
    """Medical code claims → later date of the first gap pair (row-count guard) →
    "ever" exclusion on every exclusion key."""
    inc, exc = ctx.config.inclusion(name), ctx.config.exclusion(name)
    ever = _ever_codes(exc, None)
    rules = [LineRule(name, "inclusion", "icd", tuple(inc["icd_codes"]), tuple(MEDICAL))]
    if ever:
        rules.append(LineRule(name, "ever", "icd", tuple(ever)))
    index = strategy_pass(
        role_days(ctx, rules),
        "second_claim",
        int(inc.get("min_days_between_claims", 30)),
        int(inc.get("min_claims", 2)),
        ever=bool(ever),
    )
    return _finish(ctx, index, name)


# --- cardiometabolic ----------------------------------------------------------------


def cardiometabolic_strategy(ctx: CohortContext, name: str) -> DataFrame:
    """First claim (min_claims 1) or later date of the first gap pair, then procedure
    AND drug support (ever) when configured."""
    inc = ctx.config.inclusion(name)
    procs = tuple(inc.get("procedure_codes", []) or ())
    drugs = tuple(inc.get("medication_codes", []) or ())
    use_proc = bool(inc.get("allow_procedure") and "procedure_codes" in inc and procs)
    use_drug = bool(inc.get("allow_medication") and "medication_codes" in inc and drugs)
    rules = [LineRule(name, "inclusion", "icd", tuple(inc["icd_codes"]), _types(inc))]
    support = []
    if use_proc:
        rules.append(LineRule(name, "procedure", "proc", procs))
        support.append("procedure")
    if use_drug:
        rules.append(LineRule(name, "drug", "drug", drugs))
        support.append("drug")
    if int(inc.get("min_claims", 2)) == 1:
        kind, min_days = "first_claim", 0
    else:
        kind, min_days = "second_claim", int(inc.get("min_days_between_claims", 30))
    index = strategy_pass(role_days(ctx, rules), kind, min_days, 2, support=support)
    return _finish(ctx, index, name)


STRATEGIES = {
    "diabetes": diabetes_strategy,
    "metabolic": metabolic_strategy,
    "pcos": pcos_strategy,
    "cardiometabolic": cardiometabolic_strategy,
    "declared": declared_strategy,
}


def use_strategy(cohort_name: str, strategy: str, registry: dict | None = None) -> None:
    """Register a built-in strategy for a cohort (in the global registry by default)."""
    (COHORT_LOGIC_REGISTRY if registry is None else registry)[cohort_name] = STRATEGIES[strategy]


def strategy_registry(assignments: dict[str, str]) -> dict:
    """A private registry mapping cohort names to built-in strategies."""
    return {cohort: STRATEGIES[strategy] for cohort, strategy in assignments.items()}
