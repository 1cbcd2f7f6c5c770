"""Small literal tables for unit tests."""

from __future__ import annotations

import datetime as dt

from claims_cohorts.sources.tables import ClaimsTables

CLAIMS_SCHEMA = "member_id_hash string, date_of_service date, icd_code string, claim_type string"
INDEX_SCHEMA = "member_id_hash string, index_date date"
EVENT_SCHEMA = "member_id_hash string, date_of_service date"


def D(text):
    return None if text is None else dt.date.fromisoformat(text)


def claims(spark, rows):
    """rows: (member, 'YYYY-MM-DD', code='X', type='medical')"""
    full = []
    for r in rows:
        m, day = r[0], r[1]
        code = r[2] if len(r) > 2 else "X"
        typ = r[3] if len(r) > 3 else "medical"
        full.append((m, D(day), code, typ))
    return spark.createDataFrame(full, CLAIMS_SCHEMA)


def index(spark, rows):
    return spark.createDataFrame([(m, D(day)) for m, day in rows], INDEX_SCHEMA)


def events(spark, rows):
    return spark.createDataFrame([(m, D(day)) for m, day in rows], EVENT_SCHEMA)


def as_set(df, *cols):
    cols = cols or df.columns
    return {tuple(r[c] for c in cols) for r in df.collect()}


def claims_tables(spark, entries, diagnoses, procedures=(), drugs=(), members=None, eligibility=None):
    """entries: (id, member, 'date', type); diagnoses: (id, code); procedures: (id, code); drugs: (id, name)."""
    e = spark.createDataFrame(
        [(i, m, D(day), t) for i, m, day, t in entries],
        "claim_entry_id long, member_id_hash string, date_of_service date, claim_type string",
    )
    dx = spark.createDataFrame(list(diagnoses), "claim_entry_id long, icd_code string")
    pr = spark.createDataFrame(list(procedures), "claim_entry_id long, proc_code string")
    dr = spark.createDataFrame(list(drugs), "claim_entry_id long, product_service_name string")
    mem = spark.createDataFrame(members or [], "member_id_hash string, member_name string")
    el = None
    if eligibility is not None:
        el = spark.createDataFrame(
            [(m, D(s), D(t)) for m, s, t in eligibility],
            "member_id_hash string, date_of_enrollment date, termination_date date",
        )
    return ClaimsTables(entries=e, diagnoses=dx, procedures=pr, drugs=dr, members=mem, eligibility=el)
