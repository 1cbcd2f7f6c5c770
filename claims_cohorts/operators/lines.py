"""Claim lines: every coded line a rule needs, from all three line tables, joined to
claim entries once.

Diagnosis, procedure and drug lines are each filtered and labelled on their own table
(diagnosis lines through the codebook of distinct codes), unioned, and joined to
``claims_entries`` in one join. So a run over all cohorts shuffles the entries table
once, however many rules and line tables it uses. What all rules have in common (a list
of claim types, an oldest date) filters the entries before the join; the exact limits of
each rule come from a small broadcast table (one row per rule, bounded by the
configuration) and are applied after it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import CLAIM_ID, CLAIM_TYPE, COHORT, DATE, DRUG, ICD, MEMBER, PROC
from claims_cohorts.functions.codes import all_of, drug_match, procedure_match
from claims_cohorts.operators.claims import tag_claims
from claims_cohorts.operators.codebook import any_rule, codebook
from claims_cohorts.sources.tables import ClaimsTables

LIMIT_SCHEMA = "cohort string, role string, claim_types array<string>, date_range_years int"
# FIXED VALUES — sentinel procedure code and the claim type of drug lines.
PROCEDURE_SENTINEL = "0000000"
PHARMACY = "pharma"


@dataclass(frozen=True)
class LineRule:
    """A labelled rule: ``kind`` is ``icd``, ``proc`` or ``drug``."""

    cohort: str
    role: str
    kind: str
    codes: tuple[str, ...]
    claim_types: tuple[str, ...] | None = None
    date_range_years: int | None = None


def _label(rules: Sequence[LineRule], match, col: str) -> list[tuple[dict, Column]]:
    return [({COHORT: r.cohort, "role": r.role}, match(r.codes, col)) for r in rules]


def _anchor(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def unique_rules(rules: Sequence[LineRule]) -> list[LineRule]:
    """One rule per (cohort, role): repeated rules merge their codes, so a claim line
    counts once for it; rules that differ in kind or limits can't be merged."""
    merged: dict[tuple[str, str], LineRule] = {}
    for r in rules:
        if not r.codes:
            continue
        old = merged.get((r.cohort, r.role))
        if old is None:
            merged[r.cohort, r.role] = r
        elif (old.kind, old.claim_types, old.date_range_years) != (r.kind, r.claim_types, r.date_range_years):
            raise ValueError(f"two different rules for cohort {r.cohort!r}, role {r.role!r}")
        else:
            merged[r.cohort, r.role] = replace(old, codes=tuple(dict.fromkeys(old.codes + r.codes)))
    return list(merged.values())


def _diagnosis_lines(tables: ClaimsTables, rules: Sequence[LineRule]):
    triples = [(r.cohort, r.role, r.codes) for r in rules]
    dx = tables.diagnoses.select(CLAIM_ID, ICD).where(any_rule(triples))
    if len(rules) == 1:  # one label for all lines: no look-up needed
        return dx.select(CLAIM_ID, F.lit(rules[0].cohort).alias(COHORT), F.lit(rules[0].role).alias("role"))
    return dx.join(codebook(tables.diagnoses, triples), ICD).select(CLAIM_ID, COHORT, "role")


def _types(rule: LineRule) -> tuple[str, ...] | None:
    return (PHARMACY,) if rule.kind == "drug" else rule.claim_types


def common_entry_filter(rules: Sequence[LineRule], as_of=None) -> Column | None:
    """The strictest predicate on entries that no rule's limits contradict: the union of
    the claim types and the oldest date, each only if every rule has such a limit."""
    preds = []
    types = [_types(r) for r in rules]
    if all(t is not None for t in types):
        preds.append(F.col(CLAIM_TYPE).isin(sorted({x for t in types for x in t})))
    years = [r.date_range_years for r in rules]
    if all(y is not None for y in years):
        preds.append(F.col(DATE) >= F.add_months(_anchor(as_of), -12 * max(years)))
    return all_of(preds) if preds else None


def _procedure_lines(tables: ClaimsTables, rules: Sequence[LineRule]):
    codes = [c for r in rules for c in r.codes]
    procs = tables.procedures.select(CLAIM_ID, PROC).where(procedure_match(codes, PROC) & (F.col(PROC) != PROCEDURE_SENTINEL))
    return tag_claims(procs, _label(rules, procedure_match, PROC)).select(CLAIM_ID, COHORT, "role")


def _drug_lines(tables: ClaimsTables, rules: Sequence[LineRule]):
    names = [c for r in rules for c in r.codes]
    drugs = tables.drugs.select(CLAIM_ID, DRUG).where(
        drug_match(names, DRUG) & F.col(DRUG).isNotNull() & (F.col(DRUG) != "")
    )
    return tag_claims(drugs, _label(rules, drug_match, DRUG)).select(CLAIM_ID, COHORT, "role")


def claim_lines(tables: ClaimsTables, rules: Sequence[LineRule], as_of=None) -> DataFrame:
    """(cohort, role, member_id_hash, date_of_service, claim_type): one row per claim
    line satisfying a rule (a line satisfying n rules comes out n times).

    Rules with no lines (e.g. an empty code list) contribute nothing. Drug rules only
    count pharmacy claims; procedure rules skip the sentinel code; drug rules skip
    null and empty names.
    """
    rules = unique_rules(rules)
    if not rules:
        raise ValueError("claim_lines needs at least one rule with codes")
    makers = {"icd": _diagnosis_lines, "proc": _procedure_lines, "drug": _drug_lines}
    parts = [make(tables, some) for kind, make in makers.items() if (some := [r for r in rules if r.kind == kind])]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)

    entries = tables.entries_typed()
    common = common_entry_filter(rules, as_of)
    if common is not None:
        entries = entries.where(common)
    joined = entries.join(lines, CLAIM_ID)
    if len(rules) == 1:  # its limits are the common ones
        return joined.select(COHORT, "role", MEMBER, DATE, CLAIM_TYPE)
    limits = [(r.cohort, r.role, list(t) if (t := _types(r)) is not None else None, r.date_range_years) for r in rules]
    limit_df = F.broadcast(tables.entries.sparkSession.createDataFrame(limits, LIMIT_SCHEMA))

    joined = joined.join(limit_df, [COHORT, "role"])
    types_ok = F.col("claim_types").isNull() | F.array_contains(F.col("claim_types"), F.col(CLAIM_TYPE))
    years = F.col("date_range_years")
    date_ok = years.isNull() | (F.col(DATE) >= F.add_months(_anchor(as_of), -12 * years))
    return joined.where(types_ok & date_ok).select(COHORT, "role", MEMBER, DATE, CLAIM_TYPE)
