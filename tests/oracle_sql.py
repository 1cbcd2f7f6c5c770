"""DuckDB oracle SQL for every registered query.

Written directly from the cohort semantics with plain SQL (LIKE patterns, LEAD/LAG,
correlated EXISTS), independent of the Spark operators. The claims tables are
derived from the raw test tables with the same mapping as the Spark side.
"""

from __future__ import annotations

import os

import yaml

HERE = os.path.dirname(os.path.abspath(__file__))
CONFIG = os.path.join(os.path.dirname(HERE), "claims_cohorts", "config", "cohorts.yaml")

with open(CONFIG) as _f:
    COHORTS = yaml.safe_load(_f)["cohorts"]

# FIXED VALUES — as-of date and the 48-code diagnosis codebook of the test-data mapping
# (same values as claims_cohorts/sources/testdata.py).
AS_OF = "2001-08-01"
CODEBOOK = [
    "K58.0", "K580", "K58.1", "K58.2", "K58.9", "K50.90", "K51.0",
    "K90.0", "R10", "R10.9", "R14", "R19.7", "I10", "I11.9",
    "I119", "I12.0", "I15.0", "I20.0", "I21.4", "I25.10", "I257",
    "E78.0", "E78.1", "E785", "E78.6", "E08.9", "E10.9", "E11.9",
    "E119", "R73.03", "R73.9", "O24.41", "O24.0", "O99.81", "O00.1",
    "E88.81", "E88810", "E66.9", "E66.3", "Z68.22", "Z68.27",
    "Z68.35", "E28.2", "E25.0", "E24.9", "C50.9", "B20", "Z00.00",
]
# FIXED VALUES — probe pattern lists (same as claims_cohorts/plans/queries.py).
ICD_PROBE_CODES = ["K58.*", "R10.", "I10", "E78.0", "O24.4*", "C*", "Z68.3*"]
DRUG_PROBE_NAMES = ["LISINOPRIL", "ATORVASTATIN%", "ACETAMINOPHEN*"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BASE = [
    "claims_entries AS (SELECT o_orderkey AS claim_entry_id, CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE "
    "CAST(CASE WHEN o_custkey % 13 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS VARCHAR) END AS member_id_hash, "
    "CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date_of_service, "
    "CASE WHEN o_orderkey % 4 = 3 THEN 'pharma' ELSE 'medical' END AS claim_type FROM orders)",
    "codebook(k, code) AS (VALUES " + ", ".join(f"({i}, {q(c)})" for i, c in enumerate(CODEBOOK)) + ")",
    "claims_diagnoses AS (SELECT l_orderkey AS claim_entry_id, COALESCE(cb.code, 'Z00.00') AS icd_code "
    "FROM lineitem LEFT JOIN codebook cb ON cb.k = l_partkey % 100)",
    "claims_procedures AS (SELECT l_orderkey AS claim_entry_id, CASE (l_suppkey*7 + l_linenumber) % 30 "
    "WHEN 0 THEN '33510' WHEN 1 THEN '92960' WHEN 2 THEN '0000000' ELSE '99213' END AS proc_code FROM lineitem)",
    "claims_drugs AS (SELECT l_orderkey AS claim_entry_id, CASE (l_partkey + l_linenumber) % 20 WHEN 0 THEN 'LISINOPRIL' "
    "WHEN 1 THEN 'ATORVASTATIN CALCIUM' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'ATORVASTATIN CALCIUM 20MG' "
    "ELSE 'ACETAMINOPHEN' END AS product_service_name FROM lineitem)",
    "members AS (SELECT CAST(c_custkey AS VARCHAR) AS member_id_hash, c_name AS member_name, c_mktsegment AS member_segment "
    "FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name || ' (2)', c_mktsegment FROM customer WHERE c_custkey % 29 = 0)",
    "spans AS (SELECT c_custkey, CAST(DATE '1995-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS DATE) AS s, "
    "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(DATE '1999-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER)) AS DATE) END AS e FROM customer)",
    "eligibility AS (SELECT CAST(c_custkey AS VARCHAR) AS member_id_hash, s AS date_of_enrollment, e AS termination_date FROM spans "
    "UNION ALL SELECT CAST(c_custkey AS VARCHAR), s + 400, CAST(NULL AS DATE) FROM spans WHERE c_custkey % 7 = 0 "
    "UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(NULL AS DATE), e FROM spans WHERE c_custkey % 17 = 0)",
    "dx AS (SELECT e.member_id_hash, e.date_of_service, d.icd_code, e.claim_type FROM claims_entries e "
    "JOIN claims_diagnoses d ON e.claim_entry_id = d.claim_entry_id)",
]


def sql(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(BASE + ctes) + "\n" + select


# --- predicates in SQL LIKE form --------------------------------------


def icd_sql(codes, col="icd_code") -> str:
    parts = []
    for code in codes:
        if "*" in code or "." in code:
            v = code.replace("*", "%")
            if "." in v:
                parts.append(f"({col} LIKE {q(v)} OR {col} LIKE {q(v.replace('.', ''))})")
            else:
                parts.append(f"{col} LIKE {q(v)}")
        else:
            parts.append(f"{col} = {q(code)}")
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


def proc_sql(codes, col="proc_code") -> str:
    parts = [f"{col} LIKE {q(c.replace('*', '%'))}" if ("*" in c or "." in c) else f"{col} = {q(c)}" for c in codes]
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


def drug_sql(names, col="product_service_name") -> str:
    parts = [f"{col} LIKE {q(n)}" if ("*" in n or "%" in n) else f"{col} = {q(n)}" for n in names]
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


def types_sql(types, col="claim_type") -> str:
    return f"{col} IN ({', '.join(q(t) for t in types)})" if types else "FALSE"


def claims_sql(codes, types=None, years=None) -> str:
    where = [icd_sql(codes)]
    if types is not None:
        where.append(types_sql(types))
    if years is not None:
        where.append(f"date_of_service >= CAST(DATE '{AS_OF}' - INTERVAL {int(years)} YEAR AS DATE)")
    return "SELECT member_id_hash, date_of_service, icd_code, claim_type FROM dx WHERE " + " AND ".join(where)


def first_pair_sql(src: str, min_days: int) -> str:
    return (
        "SELECT member_id_hash, MIN(date_of_service) AS index_date FROM ("
        "SELECT member_id_hash, date_of_service, LEAD(date_of_service) OVER "
        f"(PARTITION BY member_id_hash ORDER BY date_of_service) AS nxt FROM {src} WHERE member_id_hash IS NOT NULL) t "
        f"WHERE nxt IS NOT NULL AND date_diff('day', date_of_service, nxt) >= {int(min_days)} GROUP BY member_id_hash"
    )


def second_claim_sql(src: str, min_days: int, min_rows: int = 2) -> str:
    return (
        "SELECT member_id_hash, MIN(date_of_service) AS index_date FROM ("
        "SELECT member_id_hash, date_of_service, LAG(date_of_service) OVER "
        "(PARTITION BY member_id_hash ORDER BY date_of_service) AS prv, "
        f"COUNT(*) OVER (PARTITION BY member_id_hash) AS n FROM {src} WHERE member_id_hash IS NOT NULL) t "
        f"WHERE prv IS NOT NULL AND date_diff('day', prv, date_of_service) >= {int(min_days)} AND n >= {int(min_rows)} "
        "GROUP BY member_id_hash"
    )


def first_claim_sql(src: str) -> str:
    return (
        f"SELECT member_id_hash, MIN(date_of_service) AS index_date FROM {src} WHERE member_id_hash IS NOT NULL "
        "GROUP BY member_id_hash HAVING MIN(date_of_service) IS NOT NULL"
    )


def span_sql(idx: str, src: str, within_days: int, min_claims: int) -> str:
    return (
        f"SELECT * FROM {idx} WHERE member_id_hash IN (SELECT member_id_hash FROM {src} GROUP BY member_id_hash "
        f"HAVING COUNT(*) >= {int(min_claims)} AND date_diff('day', MIN(date_of_service), MAX(date_of_service)) <= {int(within_days)})"
    )


def proc_members_sql(codes) -> str:
    return (
        "SELECT DISTINCT e.member_id_hash FROM claims_procedures p JOIN claims_entries e ON p.claim_entry_id = e.claim_entry_id "
        f"WHERE e.member_id_hash IS NOT NULL AND {proc_sql(codes, 'p.proc_code')} AND p.proc_code <> '0000000'"
    )


def drug_members_sql(names) -> str:
    return (
        "SELECT DISTINCT e.member_id_hash FROM claims_drugs d JOIN claims_entries e ON d.claim_entry_id = e.claim_entry_id "
        f"WHERE e.member_id_hash IS NOT NULL AND e.claim_type = 'pharma' AND {drug_sql(names, 'd.product_service_name')} "
        "AND d.product_service_name IS NOT NULL AND d.product_service_name <> ''"
    )


def proc_events_sql(codes) -> str:
    return (
        "SELECT e.member_id_hash, e.date_of_service FROM claims_procedures p JOIN claims_entries e ON p.claim_entry_id = e.claim_entry_id "
        f"WHERE {proc_sql(codes, 'p.proc_code')} AND p.proc_code <> '0000000'"
    )


def drug_events_sql(names) -> str:
    return (
        "SELECT e.member_id_hash, e.date_of_service FROM claims_drugs d JOIN claims_entries e ON d.claim_entry_id = e.claim_entry_id "
        f"WHERE e.claim_type = 'pharma' AND {drug_sql(names, 'd.product_service_name')} "
        "AND d.product_service_name IS NOT NULL AND d.product_service_name <> ''"
    )


def not_within_sql(idx: str, events: str, days: int) -> str:
    return (
        f"SELECT * FROM {idx} i WHERE NOT EXISTS (SELECT 1 FROM {events} ev WHERE ev.member_id_hash = i.member_id_hash "
        f"AND abs(date_diff('day', i.index_date, ev.date_of_service)) <= {int(days)})"
    )


def not_ever_sql(idx: str, events: str) -> str:
    return f"SELECT * FROM {idx} i WHERE i.member_id_hash NOT IN (SELECT member_id_hash FROM {events} WHERE member_id_hash IS NOT NULL)"


def lookback_rows_sql(src: str, events: str, months: int) -> str:
    return (
        f"SELECT * FROM {src} c WHERE NOT EXISTS (SELECT 1 FROM {events} ev WHERE ev.member_id_hash = c.member_id_hash "
        f"AND ev.date_of_service < c.date_of_service "
        f"AND ev.date_of_service >= CAST(c.date_of_service - INTERVAL {int(months)} MONTH AS DATE))"
    )


HTN = COHORTS["HTN_Conservative"]["inclusion"]
CAD = COHORTS["CAD_Conservative"]["inclusion"]
IBS_D = COHORTS["IBS_D"]
PRE = COHORTS["PreDiabetes"]
DM_CODES = COHORTS["Diabetes_General"]["inclusion"]["icd_codes"]

HTN_CTES = [f"inc AS ({claims_sql(HTN['icd_codes'], HTN['claim_types'])})", f"idx AS ({first_pair_sql('inc', 30)})"]
IBS_D_CTES = [
    f"inc AS ({claims_sql(IBS_D['inclusion']['icd_codes'], IBS_D['inclusion']['claim_types'])})",
    f"idx0 AS ({first_pair_sql('inc', 30)})",
    f"idx AS ({span_sql('idx0', 'inc', 360, 2)})",
]
PRE_CTES = [
    f"inc AS ({claims_sql(PRE['inclusion']['icd_codes'], PRE['inclusion']['claim_types'])})",
    f"idx AS ({second_claim_sql('inc', 30, 2)})",
]
CAD_CTES = [f"inc AS ({claims_sql(CAD['icd_codes'], CAD['claim_types'])})", f"idx AS ({first_pair_sql('inc', 30)})"]


# --- default-path cohorts -----------------------------------------------------------


def cohort_ctes(name: str, p: str) -> tuple[list[str], str]:
    cfg = COHORTS[name]
    inc = cfg["inclusion"]
    exc = cfg.get("exclusion") or {}
    ctes = [f"{p}inc AS ({claims_sql(inc['icd_codes'], inc.get('claim_types'), inc.get('date_range_years'))})"]
    ctes.append(f"{p}i0 AS ({first_pair_sql(p + 'inc', inc.get('min_days_between_claims', 0))})")
    cur = f"{p}i0"
    if "within_months" in inc:
        ctes.append(f"{p}i1 AS ({span_sql(cur, p + 'inc', inc['within_months'] * 30, inc['min_claims'])})")
        cur = f"{p}i1"
    has_p = bool(inc.get("allow_procedure") and "procedure_codes" in inc and inc.get("procedure_codes"))
    has_d = bool(inc.get("allow_medication") and "medication_codes" in inc and inc.get("medication_codes"))
    both = inc.get("require_both_procedure_and_medication", True)
    conds = []
    pm = f"member_id_hash IN ({proc_members_sql(inc.get('procedure_codes', []))})" if has_p else None
    dm = f"member_id_hash IN ({drug_members_sql(inc.get('medication_codes', []))})" if has_d else None
    if both:
        conds = [c for c in (pm, dm) if c]
    elif has_d:
        conds = [f"({pm} OR {dm})"] if has_p else [dm]
    if conds:
        ctes.append(f"{p}i2 AS (SELECT * FROM {cur} WHERE {' AND '.join(conds)})")
        cur = f"{p}i2"
    if "subtypes" in exc and "subtype_window_days" in exc:
        ctes.append(f"{p}sub AS (SELECT member_id_hash, date_of_service FROM dx WHERE {icd_sql(exc['subtypes'])})")
        ctes.append(f"{p}i3 AS ({not_within_sql(cur, p + 'sub', exc['subtype_window_days'])})")
        cur = f"{p}i3"
    if "organic_gi" in exc and "organic_gi_window_days" in exc:
        ctes.append(f"{p}org AS (SELECT member_id_hash, date_of_service FROM dx WHERE {icd_sql(exc['organic_gi'])})")
        ctes.append(f"{p}i4 AS ({not_within_sql(cur, p + 'org', exc['organic_gi_window_days'])})")
        cur = f"{p}i4"
    select = (
        f"SELECT i.member_id_hash, i.index_date, m.member_name, m.member_segment, {q(name)} AS cohort "
        f"FROM {cur} i LEFT JOIN members m ON i.member_id_hash = m.member_id_hash"
    )
    return ctes, select


def cohort_sql(name: str) -> str:
    ctes, select = cohort_ctes(name, "c_")
    return sql(ctes, select)


def combined_ctes() -> list[str]:
    ctes, selects = [], []
    for i, name in enumerate(COHORTS):
        c, s = cohort_ctes(name, f"c{i}_")
        ctes += c
        selects.append(s)
    ctes.append("combined AS (" + "\nUNION ALL\n".join(selects) + ")")
    return ctes


# --- strategies -----------------------------------------------------------------------


def finish_sql(cur: str, name: str) -> str:
    return (
        f"SELECT i.member_id_hash, i.index_date, m.member_name, m.member_segment, {q(name)} AS cohort "
        f"FROM {cur} i LEFT JOIN members m ON i.member_id_hash = m.member_id_hash"
    )


def ever_codes(exc, keys=None):
    chosen = exc if keys is None else [k for k in keys if k in exc]
    return [c for k in chosen for c in exc[k]]


def diabetes_ctes(name: str) -> list[str]:
    cfg = COHORTS[name]
    inc, exc = cfg["inclusion"], cfg.get("exclusion") or {}
    ctes = [f"raw AS ({claims_sql(inc['icd_codes'], inc.get('claim_types'))})"]
    if name in ("PreDiabetes", "GDM") and "lookback_no_diabetes" in inc:
        ctes.append(f"dm AS (SELECT member_id_hash, date_of_service FROM dx WHERE {icd_sql(DM_CODES)})")
        ctes.append(f"inc AS ({lookback_rows_sql('raw', 'dm', inc['lookback_no_diabetes'])})")
    else:
        ctes.append("inc AS (SELECT * FROM raw)")
    if name == "PreDiabetes":
        ctes.append(f"i0 AS ({second_claim_sql('inc', 30, 2)})")
    else:
        ctes.append(f"i0 AS ({first_pair_sql('inc', inc.get('min_days_between_claims', 30))})")
    cur = "i0"
    if name == "PreDiabetes" and "diabetes_codes" in exc:
        ctes.append(f"dmx AS (SELECT member_id_hash, date_of_service FROM dx WHERE {icd_sql(exc['diabetes_codes'])})")
        ctes.append(
            "i1 AS (SELECT * FROM i0 i WHERE NOT EXISTS (SELECT 1 FROM dmx ev WHERE ev.member_id_hash = i.member_id_hash "
            "AND ev.date_of_service <= i.index_date))"
        )
        cur = "i1"
    ever = ever_codes(exc, ["gdm_codes"])
    if name == "Diabetes_General":
        ever += ever_codes(exc, ["esrd_codes", "ckd5_codes", "htn_codes", "ckd_stages_1_4"])
    if name == "GDM":
        ever += ever_codes(exc, ["pre_existing_diabetes", "o9981_code"])
    if ever:
        ctes.append(f"evx AS (SELECT member_id_hash FROM dx WHERE {icd_sql(ever)})")
        ctes.append(f"i2 AS ({not_ever_sql(cur, 'evx')})")
        cur = "i2"
    ctes.append(f"final AS (SELECT * FROM {cur})")
    return ctes


def comp_rows_sql(components) -> str:
    parts = [
        f"SELECT {q(label)} AS component, member_id_hash, date_of_service, icd_code, claim_type FROM dx "
        f"WHERE {icd_sql(codes)} AND claim_type IN ('medical')"
        for label, codes in components.items()
    ]
    return "\nUNION ALL\n".join(parts)


def comp_window_sql(src: str, min_components: int, days: int) -> str:
    return (
        "SELECT member_id_hash, MIN(s) AS index_date FROM ("
        "SELECT a.member_id_hash, a.date_of_service AS s FROM (SELECT DISTINCT member_id_hash, date_of_service FROM "
        f"{src}) a JOIN {src} b ON a.member_id_hash = b.member_id_hash AND b.date_of_service >= a.date_of_service "
        f"AND b.date_of_service <= a.date_of_service + {int(days)} GROUP BY a.member_id_hash, a.date_of_service "
        f"HAVING COUNT(DISTINCT b.component) >= {int(min_components)}) t GROUP BY member_id_hash"
    )


MET = COHORTS["Metabolic_Syndrome"]


def metabolic_rows_ctes() -> list[str]:
    inc = MET["inclusion"]
    return [
        f"strict_inc AS ({claims_sql(inc['icd_codes'], ['medical'])})",
        f"comp AS ({comp_rows_sql(inc['components'])})",
        f"rows_all AS ({second_claim_sql('strict_inc', 30, 2)} UNION ALL "
        f"{comp_window_sql('comp', inc['min_components'], inc['component_window_days'])})",
    ]


def metabolic_ctes() -> list[str]:
    exc = MET.get("exclusion") or {}
    codes = ever_codes(exc, ["cushing", "t1dm", "pregnancy", "cancer", "hiv"])
    return metabolic_rows_ctes() + [
        f"evx AS (SELECT member_id_hash FROM dx WHERE {icd_sql(codes)})",
        f"final AS ({not_ever_sql('rows_all', 'evx')})",
    ]


def pcos_ctes() -> list[str]:
    cfg = COHORTS["PCOS"]
    inc, exc = cfg["inclusion"], cfg.get("exclusion") or {}
    return [
        f"inc AS ({claims_sql(inc['icd_codes'], ['medical'])})",
        f"i0 AS ({second_claim_sql('inc', inc.get('min_days_between_claims', 30), inc.get('min_claims', 2))})",
        f"evx AS (SELECT member_id_hash FROM dx WHERE {icd_sql(ever_codes(exc))})",
        f"final AS ({not_ever_sql('i0', 'evx')})",
    ]


def cardio_ctes(name: str) -> list[str]:
    inc = COHORTS[name]["inclusion"]
    ctes = [f"inc AS ({claims_sql(inc['icd_codes'], inc.get('claim_types'))})"]
    if inc.get("min_claims", 2) == 1:
        ctes.append(f"i0 AS ({first_claim_sql('inc')})")
    else:
        ctes.append(f"i0 AS ({second_claim_sql('inc', inc.get('min_days_between_claims', 30), 2)})")
    conds = []
    if inc.get("allow_procedure") and inc.get("procedure_codes"):
        conds.append(f"member_id_hash IN ({proc_members_sql(inc['procedure_codes'])})")
    if inc.get("allow_medication") and inc.get("medication_codes"):
        conds.append(f"member_id_hash IN ({drug_members_sql(inc['medication_codes'])})")
    ctes.append("final AS (SELECT * FROM i0" + (" WHERE " + " AND ".join(conds) if conds else "") + ")")
    return ctes


# --- rules over distinct codes ----------------------------------------------------------


def rule_lists():
    out = []
    for name, cfg in COHORTS.items():
        inc = cfg["inclusion"]
        out.append((name, "inclusion", inc["icd_codes"]))
        if "symptom_codes" in inc:
            out.append((name, "symptom_codes", inc["symptom_codes"]))
        for label, comp in (inc.get("components") or {}).items():
            out.append((name, f"component:{label}", comp))
        for key, value in (cfg.get("exclusion") or {}).items():
            if isinstance(value, list):
                out.append((name, f"exclusion:{key}", value))
        for key, value in (cfg.get("tags") or {}).items():
            out.append((name, f"tag:{key}", value))
    return out


def quality_sql(src: str, spec) -> str:
    parts = []
    for col, typ, nullable in spec:
        nulls = f"COUNT(*) FILTER (WHERE {col} IS NULL)"
        ok = "TRUE" if nullable else f"({nulls} = 0)"
        parts.append(
            f"SELECT {q(col)} AS column_name, {q(typ)} AS expected_type, {q(typ)} AS actual_type, "
            f"{'TRUE' if nullable else 'FALSE'} AS nullable, TRUE AS present, {nulls} AS null_count, {ok} AS ok FROM {src}"
        )
    return "\nUNION ALL\n".join(parts)


def profile_sql() -> str:
    rows = [
        ("claims_entries", 4), ("claims_diagnoses", 2), ("claims_procedures", 2), ("claims_drugs", 2), ("members", 3),
    ]
    parts = [
        f"SELECT {q(t)} AS table_name, TRUE AS required, TRUE AS present, '' AS missing_columns, "
        f"CAST({n} AS BIGINT) AS n_columns, COUNT(*) AS row_count FROM {t}"
        for t, n in rows
    ]
    parts.append(
        "SELECT 'claims_members_monthly_utilization' AS table_name, FALSE AS required, FALSE AS present, "
        "'member_id_hash' AS missing_columns, CAST(0 AS BIGINT) AS n_columns, CAST(NULL AS BIGINT) AS row_count"
    )
    return "\nUNION ALL\n".join(parts)


# FIXED VALUES — the chapters of ICD-10-CM: number, first and last category.
CHAPTERS = [
    (1, "A00", "B99"), (2, "C00", "D49"), (3, "D50", "D89"), (4, "E00", "E89"), (5, "F01", "F99"),
    (6, "G00", "G99"), (7, "H00", "H59"), (8, "H60", "H95"), (9, "I00", "I99"), (10, "J00", "J99"),
    (11, "K00", "K95"), (12, "L00", "L99"), (13, "M00", "M99"), (14, "N00", "N99"), (15, "O00", "O9A"),
    (16, "P00", "P96"), (17, "Q00", "Q99"), (18, "R00", "R99"), (19, "S00", "T88"), (20, "V00", "Y99"),
    (21, "Z00", "Z99"), (22, "U00", "U85"),
]
CHAPTER_ROWS = "chapter_rows(n, lo, hi) AS (VALUES " + ", ".join(f"({n}, {q(a)}, {q(b)})" for n, a, b in CHAPTERS) + ")"
COVERAGE = (
    "coverage AS (SELECT member_id_hash, date_of_service AS s, CASE WHEN claim_entry_id % 311 = 0 THEN DATE '2099-12-31' "
    "WHEN claim_entry_id % 173 = 0 THEN date_of_service - 1 ELSE date_of_service + CAST(claim_entry_id % 400 + 100 AS INTEGER) END AS e "
    "FROM claims_entries WHERE date_of_service IS NOT NULL)"
)


def islands_sql(src: str, gap: int) -> list[str]:
    """CTEs up to ``islands`` (member_id_hash, s, e): a span begins an island if no other span that
    begins no later reaches it; the island ends with the furthest end before the next one begins."""
    return [
        f"good AS (SELECT DISTINCT * FROM {src} WHERE member_id_hash IS NOT NULL AND s <= e)",
        "heads AS (SELECT DISTINCT member_id_hash, s FROM good a WHERE NOT EXISTS (SELECT 1 FROM good b "
        f"WHERE b.member_id_hash = a.member_id_hash AND b.s < a.s AND b.e + {gap + 1} >= a.s))",
        "bounds AS (SELECT member_id_hash, s, LEAD(s) OVER (PARTITION BY member_id_hash ORDER BY s) AS nxt FROM heads)",
        "islands AS (SELECT h.member_id_hash, h.s, MAX(g.e) AS e FROM bounds h JOIN good g ON g.member_id_hash = h.member_id_hash "
        "AND g.s >= h.s AND (h.nxt IS NULL OR g.s < h.nxt) GROUP BY h.member_id_hash, h.s)",
    ]


def episodes_sql(src: str, gap: int) -> list[str]:
    """CTEs up to ``episodes`` of the claim rows ``src``."""
    return [
        f"pdays AS (SELECT member_id_hash, date_of_service AS d, COUNT(*) AS n FROM {src} WHERE member_id_hash IS NOT NULL "
        "AND date_of_service IS NOT NULL GROUP BY ALL)",
        "pheads AS (SELECT member_id_hash, d FROM pdays a WHERE NOT EXISTS (SELECT 1 FROM pdays b WHERE b.member_id_hash = a.member_id_hash "
        f"AND b.d < a.d AND b.d >= a.d - {gap}))",
        "pnum AS (SELECT a.*, (SELECT COUNT(*) FROM pheads h WHERE h.member_id_hash = a.member_id_hash AND h.d <= a.d) AS episode FROM pdays a)",
        "episodes AS (SELECT member_id_hash, episode, MIN(d) AS episode_start, MAX(d) AS episode_end, COUNT(*) AS n_days, "
        "CAST(SUM(n) AS BIGINT) AS n_claims FROM pnum GROUP BY ALL)",
    ]


def in_episode_sql(idx: str, before: int, after: int) -> str:
    return f"SELECT 1 FROM episodes e WHERE e.member_id_hash = {idx}.member_id_hash AND {idx}.index_date BETWEEN e.episode_start - {before} AND e.episode_end + {after}"


def declared_ctes(name: str) -> tuple[list[str], str]:
    """CTEs and WHERE clause of the declared rules over the default index ``idx`` of a cohort."""
    ctes, select = cohort_ctes(name, "d_")
    ctes = ctes + [f"whole AS ({select})", "idx AS (SELECT DISTINCT member_id_hash, index_date FROM whole)"]
    return ctes, f"SELECT w.* FROM whole w WHERE EXISTS (SELECT 1 FROM kept k WHERE k.member_id_hash = w.member_id_hash AND k.index_date = w.index_date)"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["enrollment_spans"] = sql([COVERAGE, *islands_sql("coverage", 45)], "SELECT member_id_hash, s AS date_of_enrollment, e AS termination_date FROM islands")
    out["continuous_enrollment"] = sql(
        HTN_CTES + [COVERAGE, *islands_sql("coverage", 45)],
        "SELECT * FROM idx i WHERE EXISTS (SELECT 1 FROM islands f WHERE f.member_id_hash = i.member_id_hash "
        "AND f.s <= i.index_date - 360 AND f.e >= i.index_date + 360)",
    )
    out["code_chapters"] = sql(
        [CHAPTER_ROWS], "SELECT c.icd_code, r.n AS chapter FROM (SELECT DISTINCT icd_code FROM claims_diagnoses) c LEFT JOIN chapter_rows r "
        "ON substr(c.icd_code, 1, 3) BETWEEN r.lo AND r.hi"
    )
    out["chapter_days"] = sql(
        [CHAPTER_ROWS], "SELECT member_id_hash, date_of_service, CAST(SUM(DISTINCT CAST(power(2, n) AS BIGINT)) AS BIGINT) AS chapters FROM dx JOIN chapter_rows "
        "ON substr(icd_code, 1, 3) BETWEEN lo AND hi WHERE member_id_hash IS NOT NULL AND date_of_service IS NOT NULL GROUP BY ALL"
    )
    same_day = "(icd_code LIKE 'S%' OR icd_code LIKE 'T%' OR icd_code LIKE 'R%' OR substr(icd_code, 1, 3) BETWEEN 'I10' AND 'I15' OR icd_code LIKE 'E78%')"
    out["same_day_chapters"] = sql(
        [f"inc AS ({claims_sql(COHORTS['IBS_General']['inclusion']['icd_codes'])})", f"ev AS (SELECT member_id_hash, date_of_service FROM dx WHERE {same_day})"],
        "SELECT * FROM inc c WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.member_id_hash = c.member_id_hash AND ev.date_of_service = c.date_of_service)",
    )
    preg = [f"preg AS ({claims_sql(COHORTS['Metabolic_Syndrome']['exclusion']['pregnancy'])})", *episodes_sql("preg", 120)]
    out["pregnancy_episodes"] = sql(preg, "SELECT * FROM episodes")
    out["index_in_episode"] = sql(
        HTN_CTES + preg,
        "SELECT i.member_id_hash, i.index_date, e.episode, e.episode_start, e.episode_end FROM idx i JOIN episodes e "
        "ON e.member_id_hash = i.member_id_hash AND i.index_date BETWEEN e.episode_start - 90 AND e.episode_end + 60",
    )
    dgi = COHORTS["Diabetes_General"]["inclusion"]
    out["rolling_claims"] = sql(
        [f"inc AS ({claims_sql(dgi['icd_codes'], dgi['claim_types'])})",
         "days AS (SELECT DISTINCT member_id_hash, date_of_service AS d FROM inc WHERE member_id_hash IS NOT NULL AND date_of_service IS NOT NULL)",
         "dense AS (SELECT x.member_id_hash, x.d, MIN(c.date_of_service) AS f FROM days x JOIN inc c ON c.member_id_hash = x.member_id_hash "
         f"AND c.date_of_service BETWEEN x.d - {30 * dgi['within_months']} AND x.d GROUP BY x.member_id_hash, x.d HAVING COUNT(*) >= 3)"],
        "SELECT member_id_hash, MIN(d) AS index_date, MIN(f) AS window_start FROM dense GROUP BY member_id_hash",
    )
    ctes, final = declared_ctes("IBS_General")
    ix = COHORTS["IBS_General"]["exclusion"]
    out["declared_ibs_general"] = sql(
        ctes + ["spans_of AS (SELECT member_id_hash, date_of_enrollment AS s, COALESCE(termination_date, DATE '2099-12-31') AS e FROM eligibility)",
                *islands_sql("spans_of", 0),
                "kept AS (SELECT * FROM idx i WHERE EXISTS (SELECT 1 FROM islands f WHERE f.member_id_hash = i.member_id_hash AND f.s <= i.index_date - 360 "
                "AND f.e >= i.index_date + 360) AND NOT EXISTS (SELECT 1 FROM dx WHERE dx.member_id_hash = i.member_id_hash "
                f"AND {icd_sql(ix['icd_exclusion'], 'dx.icd_code')} AND dx.date_of_service BETWEEN i.index_date - 360 AND i.index_date) "
                "AND NOT EXISTS (SELECT 1 FROM dx WHERE dx.member_id_hash = i.member_id_hash AND dx.date_of_service = i.index_date "
                "AND (dx.icd_code LIKE 'S%' OR dx.icd_code LIKE 'T%')))"],
        final,
    )
    ctes, final = declared_ctes("Diabetes_General")
    out["declared_diabetes_general"] = sql(
        ctes + [f"preg AS ({claims_sql(COHORTS['Diabetes_General']['exclusion']['pregnancy_codes'])})", *episodes_sql("preg", 120),
                f"kept AS (SELECT * FROM idx WHERE NOT EXISTS ({in_episode_sql('idx', 30, 0)}))"],
        final,
    )
    ctes, final = declared_ctes("GDM")
    out["declared_gdm"] = sql(
        ctes + [f"preg AS ({claims_sql([*COHORTS['GDM']['inclusion']['icd_codes'], 'O00.*', 'O9A.*'])})", *episodes_sql("preg", 120),
                f"kept AS (SELECT * FROM idx WHERE EXISTS ({in_episode_sql('idx', 30, 0)}))"],
        final,
    )
    out["load_claims_tables"] = sql([], "SELECT * FROM claims_entries")
    ibs_g = COHORTS["IBS_General"]["inclusion"]
    out["inclusion_claims"] = sql([], claims_sql(ibs_g["icd_codes"], ibs_g.get("claim_types"), ibs_g["date_range_years"]))
    out["inclusion_claims_advanced"] = sql(
        [f"inc AS ({claims_sql(CAD['icd_codes'], CAD['claim_types'])})"],
        f"SELECT c.*, COALESCE(c.member_id_hash IN ({proc_members_sql(CAD['procedure_codes'])}), FALSE) AS has_procedure_support, "
        f"COALESCE(c.member_id_hash IN ({drug_members_sql(CAD['medication_codes'])}), FALSE) AS has_drug_support FROM inc c",
    )
    out["table_profile"] = sql([], profile_sql())
    rules = [
        f"SELECT DISTINCT {q(c)} AS cohort, {q(r)} AS role, icd_code FROM claims_diagnoses WHERE icd_code IS NOT NULL AND {icd_sql(codes)}"
        for c, r, codes in rule_lists()
    ]
    out["cohort_rules"] = sql([], "\nUNION ALL\n".join(rules))
    out["combined_cohorts"] = sql(combined_ctes(), "SELECT * FROM combined")
    out["cohort_metadata"] = sql(
        combined_ctes(),
        "SELECT cohort, COUNT(*) AS n_records, MIN(index_date) AS earliest_index_date, MAX(index_date) AS latest_index_date "
        "FROM combined GROUP BY cohort",
    )
    # the cohorts that have rows, in YAML order
    yaml_order = ", ".join(f"({q(name)}, {i})" for i, name in enumerate(COHORTS))
    out["combined_metadata"] = sql(
        combined_ctes()
        + [f"yaml_order(cohort, place) AS (VALUES {yaml_order})",
           "counted AS (SELECT cohort, place, COUNT(*) AS n FROM combined JOIN yaml_order USING (cohort) GROUP BY cohort, place)",
           "listed AS (SELECT string_agg(cohort, ',' ORDER BY place) AS names, string_agg(cohort || '=' || n, ',' ORDER BY place) AS counts FROM counted)"],
        "SELECT COUNT(*) AS total_rows, COUNT(DISTINCT cohort) AS n_cohorts, MIN(index_date) AS earliest_index_date, "
        "MAX(index_date) AS latest_index_date, COALESCE((SELECT names FROM listed), '') AS cohorts, "
        "COALESCE((SELECT counts FROM listed), '') AS cohort_counts, "
        f"strftime(DATE '{AS_OF}', '%Y%m%d_%H%M%S') AS \"timestamp\", "
        "'member_id_hash,index_date,member_name,member_segment,cohort' AS \"columns\" FROM combined",
    )
    out["claims_quality"] = sql(
        [],
        quality_sql(
            "dx",
            [("member_id_hash", "string", False), ("date_of_service", "date", False), ("icd_code", "string", False), ("claim_type", "string", True)],
        ),
    )
    c, s = cohort_ctes("HTN_Conservative", "c_")
    out["output_quality"] = sql(
        c + [f"out_rows AS ({s})"],
        quality_sql("out_rows", [("member_id_hash", "string", False), ("index_date", "date", False)]),
    )
    out["icd_filter"] = sql([], f"SELECT claim_entry_id, icd_code FROM claims_diagnoses WHERE {icd_sql(ICD_PROBE_CODES)}")
    out["procedure_filter"] = sql([], f"SELECT claim_entry_id, proc_code FROM claims_procedures WHERE {proc_sql(CAD['procedure_codes'])}")
    out["drug_filter"] = sql([], f"SELECT claim_entry_id, product_service_name FROM claims_drugs WHERE {drug_sql(DRUG_PROBE_NAMES)}")
    out["claim_type_filter"] = sql([], "SELECT * FROM claims_entries WHERE claim_type IN ('pharma')")
    out["date_range_filter"] = sql(
        [], f"SELECT * FROM claims_entries WHERE date_of_service >= CAST(DATE '{AS_OF}' - INTERVAL {ibs_g['date_range_years']} YEAR AS DATE)"
    )
    ii = IBS_D["inclusion"]
    out["symptom_flag"] = sql(
        [f"inc AS ({claims_sql(ii['icd_codes'], ii['claim_types'])})",
         f"sym AS (SELECT member_id_hash, date_of_service FROM dx WHERE {icd_sql(ii['symptom_codes'])})"],
        "SELECT c.*, EXISTS (SELECT 1 FROM sym s WHERE s.member_id_hash = c.member_id_hash "
        f"AND abs(date_diff('day', c.date_of_service, s.date_of_service)) <= {ii['symptom_window_days']}) AS has_symptom_code FROM inc c",
    )
    ie = IBS_D["exclusion"]
    out["exclude_window_subtype"] = sql(
        IBS_D_CTES + [f"ev AS (SELECT member_id_hash, date_of_service FROM dx WHERE {icd_sql(ie['subtypes'])})"],
        not_within_sql("idx", "ev", ie["subtype_window_days"]),
    )
    out["exclude_window_organic"] = sql(
        IBS_D_CTES + [f"ev AS (SELECT member_id_hash, date_of_service FROM dx WHERE {icd_sql(ie['organic_gi'])})"],
        not_within_sql("idx", "ev", ie["organic_gi_window_days"]),
    )
    pi = PRE["inclusion"]
    out["lookback_exclusion"] = sql(
        [f"raw AS ({claims_sql(pi['icd_codes'], pi['claim_types'])})",
         f"dm AS (SELECT member_id_hash, date_of_service FROM dx WHERE {icd_sql(DM_CODES)})"],
        lookback_rows_sql("raw", "dm", pi["lookback_no_diabetes"]),
    )
    out["exclude_on_or_before"] = sql(
        PRE_CTES + [f"ev AS (SELECT member_id_hash, date_of_service FROM dx WHERE {icd_sql(PRE['exclusion']['diabetes_codes'])})"],
        "SELECT * FROM idx i WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.member_id_hash = i.member_id_hash AND ev.date_of_service <= i.index_date)",
    )
    out["exclude_ever"] = sql(
        PRE_CTES + [f"ev AS (SELECT member_id_hash FROM dx WHERE {icd_sql(PRE['exclusion']['gdm_codes'])})"],
        not_ever_sql("idx", "ev"),
    )
    out["procedure_support"] = sql(HTN_CTES, f"SELECT * FROM idx WHERE member_id_hash IN ({proc_members_sql(CAD['procedure_codes'])})")
    out["drug_support"] = sql(HTN_CTES, f"SELECT * FROM idx WHERE member_id_hash IN ({drug_members_sql(CAD['medication_codes'])})")
    out["procedure_support_window"] = sql(
        HTN_CTES + [f"ev AS ({proc_events_sql(CAD['procedure_codes'])})"],
        "SELECT * FROM idx i WHERE EXISTS (SELECT 1 FROM ev WHERE ev.member_id_hash = i.member_id_hash "
        "AND ev.date_of_service >= i.index_date - 180 AND ev.date_of_service <= i.index_date)",
    )
    out["drug_support_window"] = sql(
        HTN_CTES + [f"ev AS ({drug_events_sql(CAD['medication_codes'])})"],
        "SELECT * FROM idx i WHERE EXISTS (SELECT 1 FROM ev WHERE ev.member_id_hash = i.member_id_hash "
        "AND ev.date_of_service >= i.index_date - 180 AND ev.date_of_service <= i.index_date)",
    )
    out["procedure_flag"] = sql(
        HTN_CTES, f"SELECT *, member_id_hash IN ({proc_members_sql(CAD['procedure_codes'])}) AS has_procedure_support FROM idx"
    )
    out["drug_flag"] = sql(
        HTN_CTES, f"SELECT *, member_id_hash IN ({drug_members_sql(CAD['medication_codes'])}) AS has_drug_support FROM idx"
    )
    pm = f"member_id_hash IN ({proc_members_sql(CAD['procedure_codes'])})"
    dmm = f"member_id_hash IN ({drug_members_sql(CAD['medication_codes'])})"
    out["support_and"] = sql(CAD_CTES, f"SELECT * FROM idx WHERE {pm} AND {dmm}")
    out["support_or"] = sql(CAD_CTES, f"SELECT * FROM idx WHERE {pm} OR {dmm}")
    out["member_info"] = sql(
        HTN_CTES,
        "SELECT i.member_id_hash, i.index_date, m.member_name, m.member_segment FROM idx i LEFT JOIN members m "
        "ON i.member_id_hash = m.member_id_hash",
    )
    tags = COHORTS["HTN_Conservative"]["tags"]
    tag_cols = ", ".join(
        f"EXISTS (SELECT 1 FROM dx WHERE dx.member_id_hash = i.member_id_hash AND {icd_sql(codes, 'dx.icd_code')}) AS {name}"
        for name, codes in tags.items()
    )
    out["member_tags"] = sql(HTN_CTES, f"SELECT i.*, {tag_cols} FROM idx i")
    out["clean_period"] = sql(
        HTN_CTES,
        "SELECT * FROM idx i WHERE NOT EXISTS (SELECT 1 FROM claims_entries ce WHERE ce.member_id_hash = i.member_id_hash "
        "AND ce.date_of_service < i.index_date AND ce.date_of_service >= i.index_date - 365)",
    )
    first_elig = (
        "first_elig AS (SELECT member_id_hash, date_of_enrollment, termination_date FROM (SELECT *, ROW_NUMBER() OVER "
        "(PARTITION BY member_id_hash ORDER BY date_of_enrollment NULLS LAST, termination_date NULLS LAST) AS rn FROM eligibility) t WHERE rn = 1)"
    )
    out["enrollment_filter"] = sql(
        HTN_CTES + [first_elig],
        "SELECT * FROM idx i WHERE EXISTS (SELECT 1 FROM first_elig f WHERE f.member_id_hash = i.member_id_hash "
        "AND f.date_of_enrollment <= i.index_date - 365 AND COALESCE(f.termination_date, DATE '2099-12-31') >= i.index_date + 365)",
    )
    out["index_first_pair"] = sql(HTN_CTES, "SELECT * FROM idx")
    out["index_second_claim"] = sql(PRE_CTES, "SELECT * FROM idx")
    cs = COHORTS["CAD_Sensitive"]["inclusion"]
    out["index_first_claim"] = sql([f"inc AS ({claims_sql(cs['icd_codes'], cs['claim_types'])})"], first_claim_sql("inc"))
    dg = COHORTS["Diabetes_General"]["inclusion"]
    out["within_months"] = sql(
        [f"inc AS ({claims_sql(dg['icd_codes'], dg['claim_types'])})", f"idx0 AS ({first_pair_sql('inc', 30)})"],
        span_sql("idx0", "inc", dg["within_months"] * 30, dg["min_claims"]),
    )
    mi = MET["inclusion"]
    out["component_claims"] = sql([], comp_rows_sql(mi["components"]))
    out["component_window"] = sql(
        [f"comp AS ({comp_rows_sql(mi['components'])})"], comp_window_sql("comp", mi["min_components"], mi["component_window_days"])
    )
    out["metabolic_index_rows"] = sql(metabolic_rows_ctes(), "SELECT * FROM rows_all")
    out["duration_days"] = sql(
        ["d AS (SELECT member_id_hash, CAST(CAST(member_id_hash AS BIGINT) % 31 + 1 AS INTEGER) AS n, "
         "CAST(member_id_hash AS BIGINT) % 3 AS u FROM members)"],
        "SELECT member_id_hash, n || CASE u WHEN 0 THEN 'M' WHEN 1 THEN 'D' ELSE 'Y' END AS duration, "
        "CAST(n * CASE u WHEN 0 THEN 30 WHEN 1 THEN 1 ELSE 365 END AS INTEGER) AS days FROM d",
    )
    ctes, htn = cohort_ctes("HTN_Conservative", "h_")
    for p, cohort, more in (("p_", "PreDiabetes", diabetes_ctes("PreDiabetes")), ("s_", "CAD_Sensitive", cardio_ctes("CAD_Sensitive"))):
        inner = "WITH " + ",\n".join(more) + f"\n{finish_sql('final', cohort)}"
        ctes.append(f"{p}rows AS ({inner})")
    ctes.append(f"h_rows AS ({htn})")
    pharmacy = first_claim_sql("(SELECT * FROM claims_entries WHERE claim_type = 'pharma') e")
    out["combined_with_strategies"] = sql(
        ctes,
        "SELECT * FROM h_rows UNION ALL SELECT * FROM p_rows UNION ALL SELECT * FROM s_rows UNION ALL "
        f"SELECT member_id_hash, index_date, NULL AS member_name, NULL AS member_segment, 'First_Pharmacy' AS cohort FROM ({pharmacy}) f",
    )
    out["month_spine"] = sql(
        [],
        "SELECT member_id_hash, CAST(m AS DATE) AS month_start FROM (SELECT member_id_hash, unnest(generate_series("
        "CAST(date_trunc('month', date_of_enrollment) AS TIMESTAMP), CAST(COALESCE(termination_date, DATE '2001-08-01') AS TIMESTAMP), "
        "INTERVAL 1 MONTH)) AS m FROM eligibility) t",
    )
    for name in COHORTS:
        out[f"cohort_{name}"] = cohort_sql(name)
    for key, cohort in (("prediabetes", "PreDiabetes"), ("diabetes_general", "Diabetes_General"), ("gdm", "GDM")):
        out[key] = sql(diabetes_ctes(cohort), finish_sql("final", cohort))
    out["metabolic_syndrome"] = sql(metabolic_ctes(), finish_sql("final", "Metabolic_Syndrome"))
    out["pcos"] = sql(pcos_ctes(), finish_sql("final", "PCOS"))
    out["cardio_conservative"] = sql(cardio_ctes("CAD_Conservative"), finish_sql("final", "CAD_Conservative"))
    out["cardio_sensitive"] = sql(cardio_ctes("CAD_Sensitive"), finish_sql("final", "CAD_Sensitive"))
    return out
