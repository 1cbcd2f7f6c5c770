"""Enrollment spans, same-day chapters, episodes and rolling claims against literal cases and
plain-Python loops, and the opt-in strategy that reads them from a configuration."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claims_cohorts.functions.chapters import ICD10_CHAPTERS, CodeRanges, chapter_ranges, icd10_chapter
from claims_cohorts.operators.eligibility import continuous_enrollment, enrollment_spans
from claims_cohorts.operators.index import rolling_claims_index
from claims_cohorts.operators.intervals import claim_episodes, filter_by_episode, index_in_episode, overlap_join
from claims_cohorts.operators.sameday import chapter_days, exclude_same_day_chapters
from claims_cohorts.plans.cohorts import build_cohort
from claims_cohorts.plans.spec import CohortConfig
from claims_cohorts.plans.strategies import strategy_registry
from tests.helpers import D, as_set, claims, claims_tables, index

DAY0 = dt.date(2020, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(n)


def spans_df(spark, rows):
    return spark.createDataFrame([(m, D(s), D(e)) for m, s, e in rows], "member_id_hash string, date_of_enrollment date, termination_date date")


# --- enrollment --------------------------------------------------------------------------


def test_spans_merge(spark):
    rows = [
        ("a", "2020-01-01", "2020-12-31"), ("a", "2020-03-01", "2020-04-01"), ("a", "2021-01-01", "2021-06-30"),  # nested, adjacent
        ("b", "2020-01-01", "2020-01-31"), ("b", "2020-02-03", "2020-03-01"), ("b", "2020-01-01", "2020-01-10"),  # two days missing
        ("c", "2020-01-01", None), ("c", "2022-01-01", "2022-02-01"), ("c", None, "2023-01-01"),
        ("d", "2020-05-01", "2020-04-01"), (None, "2020-01-01", None), ("e", "2020-01-01", "2020-01-01"),
    ]
    got = lambda gap: as_set(enrollment_spans(spans_df(spark, rows), gap))
    base = {("a", D("2020-01-01"), D("2021-06-30")), ("c", D("2020-01-01"), D("2099-12-31")), ("e", D("2020-01-01"), D("2020-01-01"))}
    assert got(1) == base | {("b", D("2020-01-01"), D("2020-01-31")), ("b", D("2020-02-03"), D("2020-03-01"))}
    assert got(2) == base | {("b", D("2020-01-01"), D("2020-03-01"))}


@pytest.mark.parametrize("gap", [0, 3])
def test_continuous_enrollment_equals_day_by_day(spark, gap):
    r = random.Random(gap)
    rows, idx = [], []
    for m in range(25):
        for _ in range(r.randint(0, 7)):
            s = r.randint(0, 200)
            rows.append((f"m{m}", day(s), day(s + r.randint(-2, 60))))
        idx += [(f"m{m}", day(r.randint(0, 260))) for _ in range(4)]
    idx.append((None, DAY0))
    back, ahead = 20, 15
    want = []
    for m, d in idx:
        covered = {s + dt.timedelta(k) for n, s, e in rows if n == m for k in range((e - s).days + 1)}
        days = sorted(covered)
        bridged = {a + dt.timedelta(k) for a, b in zip(days, days[1:]) if (b - a).days <= gap + 1 for k in range((b - a).days)} | covered
        if all(d + dt.timedelta(k) in bridged for k in range(-back, ahead + 1)):
            want.append((m, d))
    df = spark.createDataFrame(rows, "member_id_hash string, date_of_enrollment date, termination_date date")
    ix = spark.createDataFrame(idx, "member_id_hash string, index_date date")
    got = [tuple(x) for x in continuous_enrollment(ix, df, back, ahead, gap).collect()]
    assert sorted(got) == sorted(want) and want


def test_enrollment_of_a_member_with_most_rows(spark):
    many = spark.range(30_000).select(F.lit("hot").alias("member_id_hash"), F.expr("date_add(date'2020-01-01', cast(id % 1000 as int))").alias("date_of_enrollment"))
    many = many.withColumn("termination_date", F.col("date_of_enrollment"))
    assert as_set(enrollment_spans(many)) == {("hot", DAY0, day(999))}


# --- chapters ----------------------------------------------------------------------------


def test_chapter_of_every_category(spark):
    codes = [f"{c}{d}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for d in ("00", "01", "49", "50", "59", "60", "88", "89", "95", "96", "99", "9A", "4A")]
    codes += ["K58.0", "k58", "", "1", "H5", "O9A.1", "H60.1", "D49", "D50.9", "~~~", "中"]
    want = {c: next((n for n, lo, hi in ICD10_CHAPTERS if lo <= c[:3] <= hi), None) for c in codes}
    df = spark.createDataFrame([(c,) for c in [*codes, None]], "icd_code string").withColumn("n", icd10_chapter("icd_code"))
    assert {r["icd_code"]: r["n"] for r in df.collect()} == want | {None: None}


def test_chapter_lists():
    assert chapter_ranges(["S", "T8", 18, "I10-I15", "Z00"]).ranges == (
        ("I10", "I15", 3), ("R00", "R99", 2), ("S", "S~~", 0), ("T8", "T8~", 1), ("Z00", "Z00", 4))
    for bad in (["S", "19"], ["0"], ["99"], [""], ["B-A"], ["I10-I15", "I1"]):
        with pytest.raises(ValueError):
            chapter_ranges(bad)
    assert CodeRanges.of([]).ranges == ()


def test_same_day(spark):
    rows = [
        ("a", "2020-01-01", "K58.0"), ("a", "2020-01-01", "S72.0"), ("a", "2020-01-02", "K58.0"), ("b", "2020-01-01", "K58.0"), ("b", "2020-01-01", "T88"),
        ("c", "2020-01-01", "K58.0"), ("c", "2020-01-01", "U07"), (None, "2020-01-01", "S1"), ("d", None, "S1"), ("d", None, "K58.0"),
    ]
    df = claims(spark, rows)
    assert as_set(chapter_days(df)) == {
        ("a", D("2020-01-01"), 1 << 11 | 1 << 19), ("a", D("2020-01-02"), 1 << 11), ("b", D("2020-01-01"), 1 << 11 | 1 << 19),
        ("c", D("2020-01-01"), 1 << 11 | 1 << 22),
    }
    ibs = df.where("icd_code = 'K58.0'")
    left = exclude_same_day_chapters(ibs, df, ["S", "T"])
    assert as_set(left, "member_id_hash", "date_of_service") == {("a", D("2020-01-02")), ("c", D("2020-01-01")), ("d", None)}
    assert exclude_same_day_chapters(ibs, df, []).count() == 5
    idx = index(spark, [("a", "2020-01-01"), ("a", "2020-01-02"), ("z", "2020-01-01")])
    assert as_set(exclude_same_day_chapters(idx, df, [19], "index_date")) == {("a", D("2020-01-02")), ("z", D("2020-01-01"))}


def test_chapters_need_no_join_or_python(spark):
    df = claims(spark, [("a", "2020-01-01", "K58.0")])
    plan = chapter_days(df, chapter_ranges(["S", "T"]))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan.replace("PythonRDD", "")


# --- episodes ----------------------------------------------------------------------------


def some_claims(seed, members=20, span=300):
    r = random.Random(seed)
    rows = [(f"m{m}", day(r.randint(0, span))) for m in range(members) for _ in range(r.randint(0, 9))]
    return rows + rows[:7] + [(None, DAY0), ("m1", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "member_id_hash string, date_of_service date")


def plain_episodes(rows, gap):
    out = {}
    for m in {m for m, d in rows if m is not None}:
        days = sorted(d for n, d in rows if n == m and d is not None)
        runs = []
        for d in days:
            if runs and (d - runs[-1][-1]).days <= gap:
                runs[-1].append(d)
            else:
                runs.append([d])
        out[m] = [(k, x[0], x[-1], len(set(x)), len(x)) for k, x in enumerate(runs, 1)]
    return out


def test_episodes_and_index_inside(spark):
    rows, gap = some_claims(4), 25
    want = plain_episodes(rows, gap)
    episodes = claim_episodes(frame(spark, rows), gap)
    assert as_set(episodes) == {(m, *x) for m, xs in want.items() for x in xs}
    idx = [(f"m{m}", day(d)) for m in range(22) for d in range(0, 320, 9)]
    ix = spark.createDataFrame(idx, "member_id_hash string, index_date date")
    for before, after in ((0, 0), (30, 400), (5, 17)):
        hits = {(m, d, k, s, e) for m, d in idx for k, s, e, _, _ in want.get(m, []) if s - dt.timedelta(before) <= d <= e + dt.timedelta(after)}
        got = [tuple(r) for r in index_in_episode(ix, episodes, before, after).collect()]
        assert set(got) == hits and len(got) == len(hits)
        inside = {x[:2] for x in hits}
        assert as_set(filter_by_episode(ix, episodes, before, after)) == inside
        assert as_set(filter_by_episode(ix, episodes, before, after, inside=False)) == set(idx) - inside


def test_overlap_join_gives_each_pair_once(spark):
    r = random.Random(9)
    some = lambda n: [("a" if r.random() < 0.7 else "b", k, day(s := r.randint(0, 900)), day(s + r.randint(-1, 400))) for k in range(n)]
    left, right = some(40), some(40)
    lf = spark.createDataFrame(left, "member_id_hash string, l int, s date, e date")
    rf = spark.createDataFrame(right, "member_id_hash string, r int, rs date, re date")
    joined = overlap_join(lf, rf, (F.col("s"), F.col("e")), (F.col("rs"), F.col("re")), bucket_days=64)
    got = sorted((x["l"], x["r"]) for x in joined.collect())
    want = sorted((i, j) for m, i, s, e in left for n, j, t, f in right if m == n and s <= e and t <= f and s <= f and t <= e)
    assert got == want and joined.columns == ["member_id_hash", "l", "s", "e", "r", "rs", "re"]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- rolling claims ----------------------------------------------------------------------


@pytest.mark.parametrize("k,window,distinct", [(1, 0, False), (3, 30, False), (3, 30, True), (5, 90, False)])
def test_rolling_claims(spark, k, window, distinct):
    rows = some_claims(6)
    want = set()
    for m in {m for m, _ in rows if m is not None}:
        days = [d for n, d in rows if n == m and d is not None]
        days = sorted(set(days)) if distinct else sorted(days)
        for d in sorted(set(days)):
            near = [x for x in days if 0 <= (d - x).days <= window]
            if len(near) >= k:
                want.add((m, d, min(near)))
                break
    assert as_set(rolling_claims_index(frame(spark, rows), k, window, distinct_days=distinct)) == want


def test_rolling_claims_needs_a_number(spark):
    with pytest.raises(ValueError):
        rolling_claims_index(frame(spark, []), 0, 30)


# --- the strategy ------------------------------------------------------------------------


def test_declared_strategy(spark):
    dates = {"a": "2020-06-01", "b": "2020-06-01", "c": "2020-06-01", "d": "2020-06-01", "e": "2020-06-01"}
    entries, dx = [], []

    def add(member, date, code):
        entries.append((len(entries), member, date, "medical"))
        dx.append((len(dx), code))

    for m, d in dates.items():
        add(m, d, "K58.0")
        add(m, "2020-09-01", "K58.0")
    add("b", "2020-06-01", "S01.1")  # same day
    add("c", "2020-01-15", "K50.1")  # excluded code before the index date
    add("c", "2020-07-15", "S01.1")  # another day
    spans = [("a", "2019-01-01", "2020-06-01"), ("a", "2020-06-10", None), ("b", "2019-01-01", None), ("c", "2019-01-01", None), ("d", "2020-05-01", None), ("e", "2019-01-01", "2020-06-15")]
    inc = {"icd_codes": ["K58.*"], "min_claims": 2, "min_days_between_claims": 30, "look_back_enrollment": "6M", "look_ahead_enrollment": "2M", "enrollment_gap_days": 10}
    exc = {"same_day_exclusion_chapters": ["S", "T"], "icd_exclusion": ["K50.*"], "look_back_exclusion": "6M"}
    tables = claims_tables(spark, entries, dx, eligibility=spans)

    def members(**change):
        cfg = CohortConfig({"X": {"inclusion": {**inc, **change.get("inc", {})}, "exclusion": {**exc, **change.get("exc", {})}}})
        got = build_cohort(tables, cfg, "X", registry=strategy_registry({"X": "declared"}))
        return {r["member_id_hash"] for r in got.collect()}

    assert members() == {"a"}
    assert members(inc={"enrollment_gap_days": 0}) == set()
    assert members(exc={"same_day_exclusion_chapters": []}) == {"a", "b"}
    assert members(exc={"look_back_exclusion": "1M"}) == {"a", "c"}
    assert members(inc={"look_ahead_enrollment": "10D"}) == {"a", "e"}
    assert members(inc={"rolling_claims": 2, "within_months": 4}) == {"a"}
    assert members(inc={"rolling_claims": 2, "within_months": 3}) == set()
    assert members(exc={"pregnancy_codes": ["K58.0"]}) == set()
    assert members(inc={"pregnancy_window": True}) == {"a"}  # the cohort's own codes make the episode
