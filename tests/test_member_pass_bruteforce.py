"""Per-member strategy passes against plain-Python loops on random role days."""

import datetime as dt
import random

import pytest

from claims_cohorts.plans.member_pass import metabolic_pass, strategy_pass

BASE = dt.date(2020, 1, 1)
SCHEMA = "cohort string, role string, member_id_hash string, date_of_service date, n_claims long"


def add_months(d, n):
    y, m = divmod(d.month - 1 + n, 12)
    y += d.year
    m += 1
    day = d.day
    while True:
        try:
            return dt.date(y, m, day)
        except ValueError:
            day -= 1


def make(seed, roles):
    rng = random.Random(seed)
    rows = {}
    for i in range(80):
        m = "hot" if i < 20 else f"m{i}"
        for _ in range(rng.randint(0, 10)):
            key = ("X", rng.choice(roles), m, BASE + dt.timedelta(days=rng.randint(0, 700)))
            rows[key] = rows.get(key, 0) + rng.choice([1, 1, 2])
    return [(*k, v) for k, v in rows.items()]


def brute_strategy(rows, kind, min_days, min_rows, lookback=None, oob=False, ever=False, support=()):
    by = {}
    for _, role, m, d, n in rows:
        by.setdefault(m, {}).setdefault(role, {})[d] = n
    out = {}
    for m, roles in by.items():
        inc = dict(roles.get("inclusion", {}))
        if lookback is not None:
            dm = roles.get("lookback", {})
            inc = {d: n for d, n in inc.items() if not any(add_months(d, -lookback) <= x < d for x in dm)}
        # expand to claim rows, then plain loops over them
        ds = sorted(d for d, n in inc.items() for _ in range(n))
        idx = None
        if kind == "first_claim":
            idx = ds[0] if ds else None
        elif kind == "first_pair":
            hits = [ds[i] for i in range(len(ds) - 1) if (ds[i + 1] - ds[i]).days >= min_days]
            idx = min(hits) if hits else None
        else:
            if len(ds) >= min_rows:
                for i in range(1, len(ds)):
                    if (ds[i] - ds[i - 1]).days >= min_days:
                        idx = ds[i]
                        break
        if idx is None:
            continue
        if oob and any(x <= idx for x in roles.get("on_or_before", {})):
            continue
        if ever and roles.get("ever"):
            continue
        if any(not roles.get(r) for r in support):
            continue
        out[m] = idx
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strategy_pass(spark, seed):
    rows = make(seed, ["inclusion", "inclusion", "lookback", "on_or_before", "ever", "procedure", "drug"])
    df = spark.createDataFrame(rows, SCHEMA)
    cases = [
        dict(kind="second_claim", min_days=30, min_rows=2, lookback=12, oob=True, ever=True),
        dict(kind="first_pair", min_days=30, min_rows=2, lookback=3, ever=True),
        dict(kind="second_claim", min_days=0, min_rows=4),
        dict(kind="first_claim", min_days=0, min_rows=2, support=("procedure", "drug")),
        dict(kind="first_pair", min_days=0, min_rows=2),
    ]
    for c in cases:
        got = {
            r.member_id_hash: r.index_date
            for r in strategy_pass(
                df, c["kind"], c["min_days"], c["min_rows"], lookback_months=c.get("lookback"),
                on_or_before=c.get("oob", False), ever=c.get("ever", False), support=c.get("support", ()),
            ).collect()
        }
        want = brute_strategy(rows, c["kind"], c["min_days"], c["min_rows"], c.get("lookback"), c.get("oob", False), c.get("ever", False), c.get("support", ()))
        assert got == want, c


@pytest.mark.parametrize("seed", [4, 5])
def test_metabolic_pass(spark, seed):
    comps = ["a", "b", "c"]
    rows = make(seed, ["strict", "component:a", "component:b", "component:c", "ever"])
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.member_id_hash, r.index_date) for r in metabolic_pass(df, comps, 2, 200, 30, ever=True).collect())
    want = []
    by = {}
    for _, role, m, d, n in rows:
        by.setdefault(m, []).append((role, d, n))
    for m, items in by.items():
        if any(r == "ever" for r, _, _ in items):
            continue
        strict = sorted(d for r, d, n in items if r == "strict" for _ in range(n))
        if len(strict) >= 2:
            for i in range(1, len(strict)):
                if (strict[i] - strict[i - 1]).days >= 30:
                    want.append((m, strict[i]))
                    break
        comp = sorted((d, r) for r, d, _ in items if r.startswith("component:"))
        for s, _ in comp:
            if len({r for d, r in comp if s <= d <= s + dt.timedelta(days=200)}) >= 2:
                want.append((m, s))
                break
    assert got == sorted(want)
