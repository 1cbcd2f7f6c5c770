"""Data-quality checks as aggregates: one pass, one small result row per column."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claims_cohorts.columns import CLAIM_TYPE, COHORT, DATE, ICD, INDEX, MEMBER

# FIXED VALUES — claim-row schema: column → (type, nullable).
CLAIMS_SCHEMA: dict[str, tuple[str, bool]] = {
    MEMBER: ("string", False),
    DATE: ("date", False),
    ICD: ("string", False),
    CLAIM_TYPE: ("string", True),
}
# FIXED VALUES — cohort output schema (extra columns allowed).
OUTPUT_SCHEMA: dict[str, tuple[str, bool]] = {
    MEMBER: ("string", False),
    INDEX: ("date", False),
}

_DATE_TYPES = {"date", "timestamp", "timestamp_ntz"}


def _type_ok(expected: str, actual: str | None) -> bool:
    if actual is None:
        return False
    if expected == "date":
        return actual in _DATE_TYPES
    return actual == expected


def quality_report(spark: SparkSession, df: DataFrame, schema: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """(column, expected_type, actual_type, nullable, present, null_count, ok) per schema column.

    All null counts come from one aggregate over ``df``, whose single row is then spread out.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    present = [c for c in schema if c in types]
    counts = (
        df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
        if present
        else spark.range(1).select()
    )
    rows = []
    for c, (expected, nullable) in schema.items():
        null_count = F.col(c).cast("long") if c in types else F.lit(None).cast("long")
        ok = F.lit(_type_ok(expected, types.get(c)))
        if not nullable and c in types:
            ok = ok & (null_count == 0)
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(expected).alias("expected_type"),
                F.lit(types.get(c)).cast("string").alias("actual_type"),
                F.lit(nullable).alias("nullable"),
                F.lit(c in types).alias("present"),
                null_count.alias("null_count"),
                ok.alias("ok"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def claims_quality(spark: SparkSession, claims: DataFrame) -> DataFrame:
    return quality_report(spark, claims, CLAIMS_SCHEMA)


def output_quality(spark: SparkSession, cohort: DataFrame) -> DataFrame:
    return quality_report(spark, cohort, OUTPUT_SCHEMA)


class SchemaError(ValueError):
    """Raised by :func:`raise_on_violations` with every failing cohort listed."""


def violation_counts(cohort: str, prefix: str) -> list[Column]:
    """Aggregates that count a cohort's nulls in each output column that must not be null."""
    own = F.col(COHORT) == cohort
    return [F.count_if(own & F.col(c).isNull()).alias(f"{prefix}null_{c}") for c, (_, nullable) in OUTPUT_SCHEMA.items() if not nullable]


def raise_on_violations(stats: Mapping[str, Mapping]) -> None:
    """``stats``: the :func:`violation_counts` of each cohort."""
    failed = {}
    for name, row in stats.items():
        nulls = {f"{c} null": row[f"null_{c}"] for c, (_, nullable) in OUTPUT_SCHEMA.items() if not nullable and row[f"null_{c}"]}
        if nulls:
            failed[name] = nulls
    if failed:
        raise SchemaError(f"cohort output failed validation: {failed}")
