"""Rules that cohort configurations declare but the default path does not evaluate.

Opt-in: ``use_strategy("IBS_General", "declared")``. The strategy takes the index rows of the
default path and applies, in this order, what the cohort's configuration sets:

* ``inclusion.look_back_enrollment`` / ``look_ahead_enrollment`` (duration text) with
  ``inclusion.enrollment_gap_days`` (default 0): continuous enrollment around the index date;
* ``exclusion.icd_exclusion`` with ``exclusion.look_back_exclusion`` (duration text): no such
  code from that long before the index date through it;
* ``exclusion.same_day_exclusion_chapters``: no code of these chapters on the index day;
* ``inclusion.pregnancy_window`` true: the index date falls into a pregnancy episode (of the
  cohort's own codes and the pregnancy codes);
* ``exclusion.pregnancy_codes``: the index date falls into no episode of these codes;
* ``inclusion.rolling_claims`` (number) with ``within_months`` (30 days each): that many
  claims within such a period, ending at any day.

Keys that are not set change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import COHORT, INDEX, MEMBER
from claims_cohorts.functions.codes import icd_match
from claims_cohorts.functions.dates import parse_duration_days
from claims_cohorts.operators.claims import code_claims, diagnosis_claims
from claims_cohorts.operators.eligibility import continuous_enrollment
from claims_cohorts.operators.index import rolling_claims_index
from claims_cohorts.operators.intervals import claim_episodes, filter_by_episode
from claims_cohorts.operators.sameday import exclude_same_day_chapters
from claims_cohorts.operators.temporal import EventWindow, keep_without

# FIXED VALUES — pregnancy codes of a cohort that asks for a pregnancy window.
PREGNANCY_CODES = ["O00.*", "O9A.*"]
#: Claims further apart belong to two pregnancies.
EPISODE_GAP_DAYS = 120
#: Days before the first claim of an episode that still count as pregnancy.
EPISODE_BEFORE_DAYS = 30


def _days(cfg: dict, key: str) -> int:
    return parse_duration_days(str(cfg[key])) if key in cfg else 0


def apply_declared(ctx, index: DataFrame, name: str) -> DataFrame:
    """``index`` (member, index_date, further columns) without the rows that a declared rule drops."""
    tables, inc, exc = ctx.tables, ctx.config.inclusion(name), ctx.config.exclusion(name)
    if "look_back_enrollment" in inc or "look_ahead_enrollment" in inc:
        if tables.eligibility is None:
            raise ValueError(f"cohort {name}: enrollment is asked for, but there is no eligibility table")
        gap = int(inc.get("enrollment_gap_days", 0))
        index = continuous_enrollment(index, tables.eligibility, _days(inc, "look_back_enrollment"), _days(inc, "look_ahead_enrollment"), gap)
    if "icd_exclusion" in exc and "look_back_exclusion" in exc:
        events = code_claims(tables, exc["icd_exclusion"])
        index = keep_without(index, events, EventWindow.lookback_days(_days(exc, "look_back_exclusion"), inclusive_anchor=True))
    if exc.get("same_day_exclusion_chapters"):
        index = exclude_same_day_chapters(index, diagnosis_claims(tables), exc["same_day_exclusion_chapters"], INDEX)
    if inc.get("pregnancy_window"):
        codes = [*inc["icd_codes"], *PREGNANCY_CODES]
        episodes = claim_episodes(diagnosis_claims(tables, icd_match(codes)), EPISODE_GAP_DAYS)
        index = filter_by_episode(index, episodes, EPISODE_BEFORE_DAYS)
    if exc.get("pregnancy_codes"):
        episodes = claim_episodes(diagnosis_claims(tables, icd_match(exc["pregnancy_codes"])), EPISODE_GAP_DAYS)
        index = filter_by_episode(index, episodes, EPISODE_BEFORE_DAYS, inside=False)
    if "rolling_claims" in inc and "within_months" in inc:
        claims = code_claims(tables, inc["icd_codes"], inc.get("claim_types"), inc.get("date_range_years"), ctx.as_of)
        dense = rolling_claims_index(claims, int(inc["rolling_claims"]), 30 * int(inc["within_months"])).select(MEMBER)
        index = index.join(dense, MEMBER, "left_semi")
    return index


def declared_strategy(ctx, name: str) -> DataFrame:
    from claims_cohorts.plans.cohorts import default_path, finish

    index = default_path(ctx.tables, ctx.config, [name], ctx.as_of, with_members=False).select(MEMBER, INDEX)
    return finish(apply_declared(ctx, index, name).withColumn(COHORT, F.lit(name)), ctx.tables)
