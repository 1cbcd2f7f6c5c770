"""The fused default path against a plain-Python rendering of the cohort rules.

Random claims (with same-day duplicates and a member holding a third of the lines),
a config using every default-path feature: code patterns, claim types, rolling date
range, gap, span, procedure/drug support in AND / OR / drug-only modes, and
subtype/organic window exclusions.
"""

import datetime as dt
import random

from claims_cohorts.plans.cohorts import build_cohorts
from claims_cohorts.plans.spec import config_from_text
from tests.helpers import claims_tables

CONFIG = """
cohorts:
  A:
    inclusion:
      icd_codes: ["K58.*"]
      min_claims: 2
      min_days_between_claims: 30
      date_range_years: 3
  B:
    inclusion:
      icd_codes: ["K58.0", "I10"]
      min_claims: 3
      min_days_between_claims: 0
      within_months: 36
      claim_types: ["medical"]
    exclusion:
      subtypes: ["K58.1"]
      subtype_window_days: 40
      organic_gi: ["K50."]
      organic_gi_window_days: 10
  C:
    inclusion:
      icd_codes: ["I10"]
      min_claims: 2
      min_days_between_claims: 15
      claim_types: ["medical"]
      allow_procedure: true
      procedure_codes: ["3351*"]
      allow_medication: true
      medication_codes: ["STATIN"]
  D:
    inclusion:
      icd_codes: ["I10"]
      min_claims: 2
      min_days_between_claims: 15
      allow_procedure: true
      procedure_codes: ["3351*"]
      allow_medication: true
      medication_codes: ["STATIN"]
      require_both_procedure_and_medication: false
  E:
    inclusion:
      icd_codes: ["I10"]
      min_claims: 2
      min_days_between_claims: 15
      allow_medication: true
      medication_codes: ["STATIN"]
      require_both_procedure_and_medication: false
"""
AS_OF = dt.date(2023, 1, 1)
CODES = ["K58.0", "K580", "K58.1", "K50", "K50.9", "I10", "Z00"]
PROCS = ["33510", "33520", "0000000", "99213"]
DRUGS = ["STATIN", "", None, "OTHER"]


def make(seed):
    rng = random.Random(seed)
    entries, dx, pr, dr = [], [], [], []
    cid = 0
    members = [f"m{i}" for i in range(60)]
    for m in members + ["hot"] * 40:  # "hot" gets as many claims as 40 members
        for _ in range(rng.randint(1, 12)):
            cid += 1
            day = dt.date(2019, 1, 1) + dt.timedelta(days=rng.randint(0, 1500))
            typ = rng.choice(["medical", "medical", "pharma"])
            entries.append((cid, m, day.isoformat(), typ))
            for _ in range(rng.choice([1, 1, 2])):
                dx.append((cid, rng.choice(CODES)))
            if rng.random() < 0.3:
                pr.append((cid, rng.choice(PROCS)))
            if rng.random() < 0.3:
                dr.append((cid, rng.choice(DRUGS)))
    return entries, dx, pr, dr


def icd_ok(code, patterns):
    out = False
    for p in patterns:
        if "*" in p or "." in p:
            pre = p.replace("*", "")
            variants = [p, p.replace(".", "")]
            for v in variants:
                if v.endswith("*"):
                    out |= code.startswith(v[:-1])
                else:
                    out |= code == v
        else:
            out |= code == p
    return out


def add_months(d, n):
    y, m = divmod(d.month - 1 + n, 12)
    y += d.year
    m += 1
    for day in range(d.day, 27, -1):
        try:
            return dt.date(y, m, day)
        except ValueError:
            pass
    return dt.date(y, m, min(d.day, 28))


def brute(cfg, entries, dx, pr, dr):
    ent = {c: (m, dt.date.fromisoformat(d), t) for c, m, d, t in entries}
    out = set()
    for name, c in cfg.items():
        inc, exc = c["inclusion"], c.get("exclusion") or {}
        rows = []
        for cid, code in dx:
            m, d, t = ent[cid]
            if not icd_ok(code, inc["icd_codes"]):
                continue
            if "claim_types" in inc and t not in inc["claim_types"]:
                continue
            if "date_range_years" in inc and d < add_months(AS_OF, -12 * inc["date_range_years"]):
                continue
            rows.append((m, d))
        by = {}
        for m, d in rows:
            by.setdefault(m, []).append(d)
        md = inc.get("min_days_between_claims", 0)
        index = {}
        for m, ds in by.items():
            ds.sort()
            hits = [ds[i] for i in range(len(ds) - 1) if (ds[i + 1] - ds[i]).days >= md]
            if hits:
                index[m] = min(hits)
        if "within_months" in inc:
            index = {
                m: d for m, d in index.items()
                if len(by[m]) >= inc["min_claims"] and (by[m][-1] - by[m][0]).days <= inc["within_months"] * 30
            }
        procs = inc.get("procedure_codes") if inc.get("allow_procedure") and "procedure_codes" in inc else None
        drugs = inc.get("medication_codes") if inc.get("allow_medication") and "medication_codes" in inc else None
        p_mem = {ent[cid][0] for cid, code in pr if procs and code != "0000000" and any(code.startswith(x.rstrip("*")) if x.endswith("*") else code == x for x in procs)}
        d_mem = {ent[cid][0] for cid, name_ in dr if drugs and name_ and ent[cid][2] == "pharma" and name_ in drugs}
        both = inc.get("require_both_procedure_and_medication", True)
        keep = set(index)
        if procs and both:
            keep &= p_mem
        if drugs:
            if both:
                keep &= d_mem
            elif procs:
                keep &= p_mem | d_mem
            else:
                keep &= d_mem
        index = {m: d for m, d in index.items() if m in keep}
        for key, wkey in (("subtypes", "subtype_window_days"), ("organic_gi", "organic_gi_window_days")):
            if key in exc and wkey in exc:
                ev = [(ent[cid][0], ent[cid][1]) for cid, code in dx if icd_ok(code, exc[key])]
                index = {m: d for m, d in index.items() if not any(em == m and abs((ed - d).days) <= exc[wkey] for em, ed in ev)}
        out |= {(m, d, name) for m, d in index.items()}
    return out


def test_default_path_matches_plain_python(spark):
    cfg = config_from_text(CONFIG)
    for seed in (1, 2):
        entries, dx, pr, dr = make(seed)
        t = claims_tables(spark, entries, dx, pr, dr, members=[("m1", "One")])
        got = {(r.member_id_hash, r.index_date, r.cohort) for r in build_cohorts(t, cfg, as_of=AS_OF.isoformat(), registry={}).collect()}
        want = brute(cfg.cohorts, entries, dx, pr, dr)
        assert got == want
        assert {c for _, _, c in want} >= {"A", "B", "C"}  # the fixture exercises the rules
