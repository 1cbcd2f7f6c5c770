"""Cohort plans: the default path for any number of cohorts in one pass, and the
registry of custom cohort logic.

The default path turns every cohort's rules (inclusion codes, window-exclusion codes,
support procedures and drugs) into labelled rules and reads all of them with one
claim-lines join (see ``operators/lines.py``), so N cohorts cost one join of the line
tables with the entries, not N. Per-cohort knobs (gap, span, windows, support mode)
come from a small broadcast table keyed by ``cohort``, so one plan serves all cohorts,
and every per-member step is keyed by (cohort, member).
"""

from __future__ import annotations

import logging
from collections import Counter
from dataclasses import dataclass
from typing import Any, Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import COHORT, INDEX, MEMBER
from claims_cohorts.operators.claims import anchor_and_event_claims, code_claims, compact_claims
from claims_cohorts.operators.lines import LineRule, claim_lines
from claims_cohorts.operators.members import add_member_info
from claims_cohorts.operators.support import support_flags
from claims_cohorts.operators.temporal import EventWindow, flag_rows
from claims_cohorts.plans.member_pass import ANY_DATE_ROLES, default_path_pass
from claims_cohorts.plans.spec import CohortConfig, default_path_spec
from claims_cohorts.sources.tables import ClaimsTables

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class CohortContext:
    """What custom cohort logic receives: the tables, the config and the as-of date."""

    tables: ClaimsTables
    config: CohortConfig
    as_of: Any = None


CohortFn = Callable[[CohortContext, str], DataFrame]
COHORT_LOGIC_REGISTRY: dict[str, CohortFn] = {}


def cohort_logic(name: str) -> Callable[[CohortFn], CohortFn]:
    """Decorator: ``fn(ctx, cohort_name) -> DataFrame`` replaces the default path for ``name``.

    Looked up before the config, so a registered name need not appear in the YAML.
    """

    def decorator(fn: CohortFn) -> CohortFn:
        COHORT_LOGIC_REGISTRY[name] = fn
        return fn

    return decorator


def finish(index: DataFrame, tables: ClaimsTables, with_members: bool = True) -> DataFrame:
    """(member, index_date, cohort) → member attributes joined, ``cohort`` last."""
    if not with_members or tables.members is None:
        return index.select(MEMBER, INDEX, COHORT)
    members = tables.members
    extra = [c for c in members.columns if c not in (MEMBER, INDEX, COHORT)]
    joined = add_member_info(index.select(MEMBER, INDEX, COHORT), members.select(MEMBER, *extra))
    return joined.select(MEMBER, INDEX, *extra, COHORT)


def symptom_claims(tables: ClaimsTables, icd_codes, symptom_codes, window_days: int, claim_types=None, date_range_years=None, as_of=None) -> DataFrame:
    """Inclusion claim rows with ``has_symptom_code``: a symptom claim of the member within
    ± ``window_days``. Both kinds of claims come from one read."""
    rows = anchor_and_event_claims(tables, icd_codes, symptom_codes, claim_types, date_range_years, as_of)
    flagged = flag_rows(rows, F.col("_event"), EventWindow.symmetric(window_days), "has_symptom_code")
    return flagged.where("_anchor").drop("_anchor", "_event")


def inclusion_claims_advanced(tables: ClaimsTables, inclusion: dict, as_of=None) -> DataFrame:
    """Inclusion claim rows (member, date, code, type) with the flags the configuration
    asks for: ``has_symptom_code`` (symptom codes + window), ``has_procedure_support``
    (allow_procedure + procedure_codes), ``has_drug_support`` (allow_medication +
    medication_codes). Flags are per claim row; support flags hold for the member at
    any date."""
    limits = (inclusion.get("claim_types"), inclusion.get("date_range_years"), as_of)
    if "symptom_codes" in inclusion and "symptom_window_days" in inclusion:
        claims = symptom_claims(tables, inclusion["icd_codes"], inclusion["symptom_codes"], int(inclusion["symptom_window_days"]), *limits)
    else:
        claims = code_claims(tables, inclusion["icd_codes"], *limits)
    procs = inclusion.get("procedure_codes") if inclusion.get("allow_procedure") and "procedure_codes" in inclusion else None
    drugs = inclusion.get("medication_codes") if inclusion.get("allow_medication") and "medication_codes" in inclusion else None
    return support_flags(claims, tables, procs, drugs)


def default_path(
    tables: ClaimsTables,
    config: CohortConfig,
    names: Sequence[str],
    as_of=None,
    with_members: bool = True,
) -> DataFrame:
    """Default cohort logic for the named cohorts, in one plan.

    inclusion claims → first qualifying pair (earlier date) → whole-history span →
    procedure / drug support → ±window exclusions → member attributes.
    """
    specs = [default_path_spec(config, n) for n in names]

    rules: list[LineRule] = []
    for s in specs:
        rules.append(LineRule(s.name, "inclusion", "icd", s.icd_codes, s.claim_types, s.date_range_years))
        if s.subtypes is not None:
            rules.append(LineRule(s.name, "subtypes", "icd", s.subtypes))
        if s.organic_gi is not None:
            rules.append(LineRule(s.name, "organic_gi", "icd", s.organic_gi))
        if s.support_mode != "none":
            if s.procedure_codes:
                rules.append(LineRule(s.name, "procedure", "proc", s.procedure_codes))
            if s.medication_codes:
                rules.append(LineRule(s.name, "drug", "drug", s.medication_codes))
    # One row per (cohort, role, member, day) from one claim-lines join; every
    # decision is then made in one pass over each member's days.
    days = compact_claims(claim_lines(tables, rules, as_of), [COHORT, "role"], undated=F.col("role").isin(*ANY_DATE_ROLES))
    return finish(default_path_pass(days, specs), tables, with_members)


def build_cohorts(
    tables: ClaimsTables,
    config: CohortConfig,
    names: Sequence[str] | None = None,
    as_of=None,
    with_members: bool = True,
    registry: dict[str, CohortFn] | None = None,
) -> DataFrame:
    """All named cohorts (default: every cohort in YAML order) as one DataFrame.

    Registered cohorts use their own logic; all others share one default-path plan.
    Results are concatenated (UNION ALL, missing columns null). A name given k times is
    planned once and its rows come k times.
    """
    reg = COHORT_LOGIC_REGISTRY if registry is None else registry
    asked = Counter(names if names is not None else config.names())
    names = list(asked)
    custom = [n for n in names if n in reg]
    default = [n for n in names if n not in reg]
    for n in default:
        config.cohort(n)  # unknown cohort → KeyError before any plan is built
    parts: list[DataFrame] = []
    if default:
        parts.append(default_path(tables, config, default, as_of, with_members))
    ctx = CohortContext(tables, config, as_of)
    for n in custom:
        parts.append(reg[n](ctx, n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if max(asked.values()) > 1:
        times = F.coalesce(*[F.when(F.col(COHORT) == n, F.lit(k)) for n, k in asked.items() if k > 1], F.lit(1))
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")
    return out


def build_cohort(
    tables: ClaimsTables,
    config: CohortConfig,
    name: str,
    as_of=None,
    with_members: bool = True,
    registry: dict[str, CohortFn] | None = None,
) -> DataFrame:
    """One cohort: registered logic if any, else the default path."""
    log.info("Processing cohort: %s", name)
    try:
        return build_cohorts(tables, config, [name], as_of, with_members, registry)
    except Exception as exc:
        log.error("Error processing cohort %s: %s", name, exc)
        raise
