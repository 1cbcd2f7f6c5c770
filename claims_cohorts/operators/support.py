"""Procedure and drug support: members with supporting claims, ever or in a window."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import CLAIM_ID, CLAIM_TYPE, DATE, DRUG, MEMBER, PROC
from claims_cohorts.functions.codes import drug_match, procedure_match
from claims_cohorts.operators.lines import PHARMACY, PROCEDURE_SENTINEL, LineRule, claim_lines
from claims_cohorts.operators.temporal import EventWindow, keep_with
from claims_cohorts.sources.tables import ClaimsTables


def procedure_events(tables: ClaimsTables, codes: Sequence[str]) -> DataFrame:
    """(member, date) of procedure claims matching the codes (any claim type)."""
    procs = tables.procedures.select(CLAIM_ID, PROC).where(procedure_match(codes, PROC) & (F.col(PROC) != PROCEDURE_SENTINEL))
    return tables.entries_typed().join(procs, CLAIM_ID).select(MEMBER, DATE)


def drug_events(tables: ClaimsTables, names: Sequence[str]) -> DataFrame:
    """(member, date) of pharmacy claims whose drug name matches (no null/empty names)."""
    drugs = tables.drugs.select(CLAIM_ID, DRUG).where(
        drug_match(names, DRUG) & F.col(DRUG).isNotNull() & (F.col(DRUG) != "")
    )
    entries = tables.entries_typed().where(F.col(CLAIM_TYPE) == PHARMACY)
    return entries.join(drugs, CLAIM_ID).select(MEMBER, DATE)


def supported_members(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct members (per key) having at least one supporting claim."""
    return events.select(*keys, MEMBER).where(F.col(MEMBER).isNotNull()).distinct()


def procedure_support(index: DataFrame, tables: ClaimsTables, codes: Sequence[str]) -> DataFrame:
    """Keep members with a matching procedure claim at any date."""
    if not codes:
        return index.where(F.lit(False))  # no codes: nobody has support
    return index.join(supported_members(procedure_events(tables, codes)), MEMBER, "left_semi")


def drug_support(index: DataFrame, tables: ClaimsTables, names: Sequence[str]) -> DataFrame:
    """Keep members with a matching pharmacy claim at any date."""
    if not names:
        return index.where(F.lit(False))  # no codes: nobody has support
    return index.join(supported_members(drug_events(tables, names)), MEMBER, "left_semi")


def procedure_support_window(index: DataFrame, tables: ClaimsTables, codes: Sequence[str], window_days: int = 180) -> DataFrame:
    """Keep index rows with a matching procedure in ``[index - window_days, index]``."""
    if not codes:
        return index.where(F.lit(False))  # no codes: nobody has support
    return keep_with(index, procedure_events(tables, codes), EventWindow.lookback_days(window_days, inclusive_anchor=True), prefilter=True)


def drug_support_window(index: DataFrame, tables: ClaimsTables, names: Sequence[str], window_days: int = 180) -> DataFrame:
    """Keep index rows with a matching pharmacy claim in ``[index - window_days, index]``."""
    if not names:
        return index.where(F.lit(False))  # no codes: nobody has support
    return keep_with(index, drug_events(tables, names), EventWindow.lookback_days(window_days, inclusive_anchor=True), prefilter=True)


def support_flags(
    df: DataFrame,
    tables: ClaimsTables,
    procedure_codes: Sequence[str] | None = None,
    drug_names: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``has_procedure_support`` / ``has_drug_support`` per member (False when no codes).

    A list of None leaves the column out, an empty list gives all False. Both flags
    come from one claim-lines join and one per-member aggregate.
    """
    wanted = {"procedure": ("has_procedure_support", "proc", procedure_codes), "drug": ("has_drug_support", "drug", drug_names)}
    wanted = {role: v for role, v in wanted.items() if v[2] is not None}
    rules = [LineRule("_", role, kind, tuple(codes)) for role, (_, kind, codes) in wanted.items() if codes]
    out = df
    if rules:
        lines = claim_lines(tables, rules)
        per_member = lines.groupBy(MEMBER).agg(
            *[F.max(F.col("role") == role).alias(name) for role, (name, _, codes) in wanted.items() if codes]
        )
        out = out.join(per_member, MEMBER, "left")
    for role, (name, _, codes) in wanted.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(False)) if codes else F.lit(False))
    return out


def combine_support(flags: DataFrame, mode: str) -> DataFrame:
    """Filter rows carrying both flag columns by support mode (and / or / proc / drug / none)."""
    p, d = F.col("has_procedure_support"), F.col("has_drug_support")
    if mode == "and":
        return flags.where(p & d)
    if mode == "or":
        return flags.where(p | d)
    if mode == "proc":
        return flags.where(p)
    if mode == "drug":
        return flags.where(d)
    return flags
