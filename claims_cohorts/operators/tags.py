"""Member tagging: one boolean column per tag code set, in one pass over diagnoses."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import ICD, MEMBER
from claims_cohorts.functions.codes import any_of, icd_match
from claims_cohorts.operators.claims import diagnosis_claims
from claims_cohorts.sources.tables import ClaimsTables


def member_tag_table(tables: ClaimsTables, tags: Mapping[str, Sequence[str]]) -> DataFrame:
    """(member, tag_1 … tag_n): True where the member has any claim with the tag's codes.

    Any date, any claim type. Conditional aggregation with map-side combine: one
    row per member leaves each task.
    """
    preds = {name: icd_match(codes, ICD) for name, codes in tags.items()}
    claims = diagnosis_claims(tables, any_of(preds.values()))
    return claims.groupBy(MEMBER).agg(
        *[F.max(F.when(pred, F.lit(True)).otherwise(F.lit(False))).alias(name) for name, pred in preds.items()]
    )


def member_tags(index: DataFrame, tables: ClaimsTables, tags: Mapping[str, Sequence[str]]) -> DataFrame:
    """Left-join tag flags to the index rows; members without matching claims get False."""
    if not tags:
        return index
    table = member_tag_table(tables, tags)
    out = index.join(table, MEMBER, "left")
    for name in tags:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return out
