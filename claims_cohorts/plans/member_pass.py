"""One pass per member: the default cohort path and the family strategies.

Each plan reads its roles' days (cohort, role, member, day, n_claims) from one
claim-lines join and compacts them (one shuffle by cohort, role, member and day), shuffles
them by (cohort, member), computes window columns over the member's days (nearest
earlier / later day of a role: running max / min, so linear) and decides with one
aggregate. Steps that drop claim days before the index is found (the diabetes look-back)
are a filter between two window passes on the same partitioning, so they add no shuffle.
Rules that hold at any date also get one dateless row per member, which no window sees.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claims_cohorts.columns import COHORT, DATE, INDEX, MEMBER
from claims_cohorts.functions.codes import any_of
from claims_cohorts.operators.claims import N_CLAIMS
from claims_cohorts.plans.spec import DefaultPathSpec

PART = [COHORT, MEMBER]
#: Roles whose claims count whether or not they are dated.
ANY_DATE_ROLES = ("ever", "procedure", "drug")


def _windows():
    order = F.unix_date(F.col(DATE))
    base_up = Window.partitionBy(*PART).orderBy(order)
    base_down = Window.partitionBy(*PART).orderBy(order.desc())
    return {
        "before": base_up.rangeBetween(Window.unboundedPreceding, -1),  # days strictly earlier
        "after": base_down.rangeBetween(Window.unboundedPreceding, -1),  # days strictly later
        "from": base_down.rangeBetween(Window.unboundedPreceding, 0),  # this day or later
    }


def _role_day(role: str) -> Column:
    return F.when(F.col("role") == role, F.col(DATE))


def strategy_pass(
    days: DataFrame,
    index_kind: str,
    min_days: int = 30,
    min_rows: int = 2,
    lookback_months: int | None = None,
    on_or_before: bool = False,
    ever: bool = False,
    support: Sequence[str] = (),
) -> DataFrame:
    """(cohort, member, index_date) for an inclusion role plus optional rules.

    ``index_kind``: ``first_pair`` (earlier day of the first consecutive gap >=
    min_days), ``second_claim`` (later day of it, members with >= min_rows rows) or
    ``first_claim`` (earliest day). ``lookback_months``: inclusion days with a
    ``lookback`` day in [d - months, d) are dropped first. ``on_or_before``: drop
    members with an ``on_or_before`` day <= index. ``ever``: drop members with any
    ``ever`` day. ``support``: roles the member must have at any date.
    """
    w = _windows()
    role, day = F.col("role"), F.col(DATE)
    is_inc = role == "inclusion"
    rows = days
    if lookback_months is not None:
        prev_dm = F.max(_role_day("lookback")).over(w["before"])
        hit = prev_dm >= F.add_months(day, -int(lookback_months))
        rows = rows.withColumn("_lb", F.coalesce(is_inc & hit, F.lit(False))).where(~F.col("_lb")).drop("_lb")

    same_day_pair = (F.col(N_CLAIMS) >= 2) & (F.lit(0) >= F.lit(min_days))
    if index_kind == "first_pair":
        nxt = F.min(F.when(is_inc, day)).over(w["after"])
        ok = is_inc & F.coalesce((F.datediff(nxt, day) >= min_days) | same_day_pair, F.lit(False))
    elif index_kind == "second_claim":
        prv = F.max(F.when(is_inc, day)).over(w["before"])
        ok = is_inc & F.coalesce((F.datediff(day, prv) >= min_days) | same_day_pair, F.lit(False))
    elif index_kind == "first_claim":
        ok = is_inc
    else:
        raise ValueError(f"unknown index kind {index_kind!r}")
    rows = rows.withColumn("_ok", ok)

    aggs = [
        F.min(F.when(F.col("_ok"), day)).alias(INDEX),
        F.sum(F.when(is_inc, F.col(N_CLAIMS))).alias("_rows"),
    ]
    if on_or_before:
        aggs.append(F.min(_role_day("on_or_before")).alias("_first_oob"))
    if ever:
        aggs.append(F.max(role == "ever").alias("_ever"))
    for r in support:
        aggs.append(F.max(role == r).alias(f"_has_{r}"))
    stats = rows.groupBy(*PART).agg(*aggs)

    keep = F.col(INDEX).isNotNull()
    if index_kind == "second_claim":
        keep = keep & (F.col("_rows") >= min_rows)
    if on_or_before:
        keep = keep & (F.col("_first_oob").isNull() | (F.col("_first_oob") > F.col(INDEX)))
    if ever:
        keep = keep & ~F.coalesce(F.col("_ever"), F.lit(False))
    for r in support:
        keep = keep & F.coalesce(F.col(f"_has_{r}"), F.lit(False))
    return stats.where(keep).select(*PART, INDEX)


def metabolic_pass(
    days: DataFrame,
    components: Sequence[str],
    min_components: int,
    window_days: int,
    gap_days: int = 30,
    ever: bool = False,
) -> DataFrame:
    """Strict rows (later day of the first ``strict`` gap pair, members with >= 2
    rows) UNION ALL broad rows (earliest component day s with >= min_components
    distinct components in [s, s + window_days]); a member may appear twice. Members
    with any ``ever`` day are dropped."""
    w = _windows()
    role, day = F.col("role"), F.col(DATE)
    is_strict = role == "strict"
    is_comp = role.startswith("component:")
    prv = F.max(F.when(is_strict, day)).over(w["before"])
    strict_ok = is_strict & F.coalesce((F.datediff(day, prv) >= gap_days) | (F.col(N_CLAIMS) >= 2) & (F.lit(0) >= gap_days), F.lit(False))
    end = F.date_add(day, int(window_days))
    present = [
        F.when(F.min(_role_day(f"component:{c}")).over(w["from"]) <= end, 1).otherwise(0) for c in components
    ]
    n_present = present[0]
    for p in present[1:]:
        n_present = n_present + p
    rows = days.select("*", strict_ok.alias("_strict_ok"), (is_comp & (n_present >= min_components)).alias("_broad_ok"))
    aggs = [
        F.min(F.when(F.col("_strict_ok"), day)).alias("_strict"),
        F.sum(F.when(is_strict, F.col(N_CLAIMS))).alias("_strict_rows"),
        F.min(F.when(F.col("_broad_ok"), day)).alias("_broad"),
    ]
    if ever:
        aggs.append(F.max(role == "ever").alias("_ever"))
    stats = rows.groupBy(*PART).agg(*aggs)
    if ever:
        stats = stats.where(~F.coalesce(F.col("_ever"), F.lit(False)))
    strict = F.when(F.col("_strict_rows") >= 2, F.col("_strict"))
    picked = F.array_compact(F.array(strict, F.col("_broad")))
    return stats.select(*PART, F.explode(picked).alias(INDEX))


SPEC_SCHEMA = (
    "cohort string, _min_days int, _within int, _min_claims long, _mode string, _w_subtypes int, _w_organic_gi int"
)


def _knob_rows(specs: Sequence[DefaultPathSpec]) -> list[tuple]:
    return [
        (s.name, s.min_days, s.within_days, s.min_claims, s.support_mode, s.subtype_window, s.organic_window)
        for s in specs
    ]


def cohort_knobs(spark, specs: Sequence[DefaultPathSpec]) -> DataFrame:
    """One row per cohort with its default-path knobs (bounded by the configuration)."""
    return spark.createDataFrame(_knob_rows(specs), SPEC_SCHEMA)


def with_knobs(days: DataFrame, specs: Sequence[DefaultPathSpec]) -> DataFrame:
    """The knobs of each row's cohort: a look-up, or constants if there is one cohort."""
    knobs = cohort_knobs(days.sparkSession, specs)
    if len(specs) > 1:
        return days.join(F.broadcast(knobs), COHORT)
    values = zip(knobs.schema.fields[1:], _knob_rows(specs)[0][1:])
    return days.withColumns({f.name: F.lit(v).cast(f.dataType) for f, v in values})


def default_path_pass(days: DataFrame, specs: Sequence[DefaultPathSpec]) -> DataFrame:
    """All default-path decisions for every (cohort, member) in one pass over its days.

    The cohort knobs are looked up from a broadcast table (one row per cohort), so
    the cost per row does not grow with the number of cohorts. Then one shuffle by
    (cohort, member), window columns over the member's days, and one aggregate:

    * first pair: the next inclusion day (a running minimum over later days);
    * span: row count, first and last inclusion day;
    * support: whether the member has procedure / drug days at all;
    * window exclusions: for each inclusion day the nearest subtype / organic event
      on or before it and on or after it (running max / min), compared with the
      cohort's window; the decision is read at the index day.
    """
    part = [COHORT, MEMBER]
    knobs = ["_within", "_min_claims", "_mode"]
    days = with_knobs(days, specs)
    role, day = F.col("role"), F.col(DATE)
    is_inc = role == "inclusion"
    md = F.col("_min_days")
    order = F.unix_date(day)
    up = Window.partitionBy(*part).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part).orderBy(order.desc()).rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*part).orderBy(order.desc()).rangeBetween(Window.unboundedPreceding, -1)

    # Window columns grouped by sort order (one sort each). The next inclusion day
    # strictly after this one (days are unique per role) is a running minimum in
    # descending order; nearest events before / after come from running max / min.
    windows = {"desc": {"_next_inc": F.min(F.when(is_inc, day)).over(later)}, "asc": {}}
    checks = []
    for ev_role, window_of in (("subtypes", lambda s: s.subtype_window), ("organic_gi", lambda s: s.organic_window)):
        if all(window_of(s) is None for s in specs):
            continue
        windows["asc"][f"_prev_{ev_role}"] = F.max(F.when(role == ev_role, day)).over(up)
        windows["desc"][f"_next_{ev_role}"] = F.min(F.when(role == ev_role, day)).over(down)
        checks.append((ev_role, F.col(f"_w_{ev_role}")))
    rows = days.select("*", *[c.alias(n) for n, c in windows["desc"].items()])
    if windows["asc"]:
        rows = rows.select("*", *[c.alias(n) for n, c in windows["asc"].items()])

    gap = F.datediff(F.col("_next_inc"), day)
    ok = is_inc & F.coalesce((gap >= md) | ((F.col(N_CLAIMS) >= 2) & (F.lit(0) >= md)), F.lit(False))
    rows = rows.withColumn("_ok", ok)
    hits = [
        F.coalesce(
            (F.col(f"_prev_{r}") >= F.date_sub(day, w)) | (F.col(f"_next_{r}") <= F.date_add(day, w)), F.lit(False)
        )
        for r, w in checks
    ]
    excluded = any_of(hits)

    # knobs are constant per cohort, so max() returns them; grouping by (cohort,
    # member) alone keeps the window's sort order, so the aggregate needs no sort
    stats = rows.groupBy(*part).agg(
        *[F.max(k).alias(k) for k in knobs],
        F.min(F.when(F.col("_ok"), F.struct(day.alias("d"), excluded.alias("x")))).alias("_first_ok"),
        F.sum(F.when(is_inc, F.col(N_CLAIMS))).alias("_rows"),
        F.min(F.when(is_inc, day)).alias("_first"),
        F.max(F.when(is_inc, day)).alias("_last"),
        F.max(role == "procedure").alias("_proc"),
        F.max(role == "drug").alias("_drug"),
    )
    within, mode = F.col("_within"), F.col("_mode")
    p = F.coalesce(F.col("_proc"), F.lit(False))
    d = F.coalesce(F.col("_drug"), F.lit(False))
    keep = (
        F.col("_first_ok").isNotNull()
        & ~F.col("_first_ok.x")
        & (
            within.isNull()
            | ((F.col("_rows") >= F.col("_min_claims")) & (F.datediff(F.col("_last"), F.col("_first")) <= within))
        )
        & (
            (mode == "none")
            | ((mode == "and") & p & d)
            | ((mode == "or") & (p | d))
            | ((mode == "proc") & p)
            | ((mode == "drug") & d)
        )
    )
    return stats.where(keep).select(COHORT, MEMBER, F.col("_first_ok.d").alias(INDEX))
