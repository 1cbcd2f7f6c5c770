"""Claim rows: entries joined to diagnoses, tagged by rule, compacted per day."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import CLAIM_ID, CLAIM_TYPE, DATE, ICD, MEMBER
from claims_cohorts.functions.codes import claim_type_match, date_range_filter, icd_match
from claims_cohorts.sources.tables import ClaimsTables

N_CLAIMS = "n_claims"


def diagnosis_claims(
    tables: ClaimsTables,
    diagnosis_filter: Column | None = None,
    entry_filter: Column | None = None,
) -> DataFrame:
    """Entries ⋈ diagnoses on ``claim_entry_id`` → (member, date, icd_code, claim_type).

    Filters are applied to each side before the join so they reach the scans; an
    entry with k matching codes yields k rows.
    """
    dx = tables.diagnoses.select(CLAIM_ID, ICD)
    if diagnosis_filter is not None:
        dx = dx.where(diagnosis_filter)
    entries = tables.entries_typed()
    if entry_filter is not None:
        entries = entries.where(entry_filter)
    return entries.join(dx, CLAIM_ID).select(MEMBER, DATE, ICD, CLAIM_TYPE)


def inclusion_predicates(
    icd_codes: Sequence[str],
    claim_types: Sequence[str] | None = None,
    date_range_years: int | None = None,
    as_of=None,
) -> tuple[Column, Column | None]:
    """(diagnosis predicate, entry predicate) of an inclusion rule."""
    entry_preds = []
    if claim_types is not None:
        entry_preds.append(claim_type_match(claim_types, CLAIM_TYPE))
    if date_range_years is not None:
        entry_preds.append(date_range_filter(date_range_years, as_of, DATE))
    entry = None
    for p in entry_preds:
        entry = p if entry is None else entry & p
    return icd_match(icd_codes, ICD), entry


def code_claims(
    tables: ClaimsTables,
    icd_codes: Sequence[str],
    claim_types: Sequence[str] | None = None,
    date_range_years: int | None = None,
    as_of=None,
) -> DataFrame:
    """Claim rows whose code matches the patterns (and claim types / date range)."""
    dx_pred, entry_pred = inclusion_predicates(icd_codes, claim_types, date_range_years, as_of)
    return diagnosis_claims(tables, dx_pred, entry_pred)


def anchor_and_event_claims(
    tables: ClaimsTables,
    anchor_codes: Sequence[str],
    event_codes: Sequence[str],
    anchor_types: Sequence[str] | None = None,
    date_range_years: int | None = None,
    as_of=None,
) -> DataFrame:
    """Claim rows matching either code list, read once, with booleans ``_anchor`` (the
    anchor list and its limits hold) and ``_event`` (the event list)."""
    dx, entry = inclusion_predicates(anchor_codes, anchor_types, date_range_years, as_of)
    event = icd_match(event_codes, ICD)
    claims = diagnosis_claims(tables, dx | event)
    anchor = dx if entry is None else dx & F.coalesce(entry, F.lit(False))
    return claims.withColumns({"_anchor": anchor, "_event": event}).where("_anchor or _event")


def tag_claims(claims: DataFrame, rules: Sequence[tuple[dict, Column]]) -> DataFrame:
    """Label each claim row with every rule it satisfies, in one scan.

    ``rules`` is a list of ``(labels, predicate)``; ``labels`` maps output column names
    to literal values (e.g. ``{"cohort": "IBS_D", "role": "inclusion"}``). A row that
    satisfies n rules comes out n times, once per label set; a row that satisfies
    none yields an empty array and no output row. Each predicate is evaluated once
    per row (callers push the union of the patterns into the scan beforehand).
    """
    if not rules:
        raise ValueError("tag_claims needs at least one rule")
    label_names = list(rules[0][0])
    if len(label_names) == 1:
        key = label_names[0]
        labels = F.array_compact(F.array(*[F.when(pred, F.lit(lab[key])) for lab, pred in rules]))
        out = claims.select(F.explode(labels).alias(key), *claims.columns)
        return out
    labels = F.array_compact(
        F.array(
            *[
                F.when(pred, F.struct(*[F.lit(lab[k]).alias(k) for k in label_names]))
                for lab, pred in rules
            ]
        )
    )
    out = claims.withColumn("_tag", F.explode(labels))
    return out.select(*[F.col(f"_tag.{k}").alias(k) for k in label_names], *claims.columns)


def compact_claims(
    claims: DataFrame,
    keys: Sequence[str] = (),
    member_col: str = MEMBER,
    date_col: str = DATE,
    undated: Column | None = None,
) -> DataFrame:
    """One row per (keys, member, day) with the number of claim rows on that day.

    Rows with a null member or date are dropped (they never pair), except that rows
    satisfying ``undated`` (rules that hold at any date) keep one dateless row per
    member. The aggregate is combined map-side, so a member with very many claims is
    reduced before the shuffle, and each member's output is bounded by the number of
    calendar days.
    """
    if N_CLAIMS in claims.columns:
        return claims
    dated = F.col(date_col).isNotNull()
    return (
        claims.where(F.col(member_col).isNotNull() & (dated if undated is None else dated | undated))
        .groupBy(*keys, member_col, date_col)
        .agg(F.count(F.lit(1)).alias(N_CLAIMS))
    )
