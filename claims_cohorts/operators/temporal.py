"""Temporal existence tests between anchor rows and event claims.

"Does the member have an event dated in [A(d), B(d)] around anchor date d?" covers
every window rule of the cohort logic: symmetric ±w windows, look-back windows in
months, on-or-before, clean periods and support windows.

Instead of a range join (which compares every anchor with every event of the
member), anchors and distinct event days are unioned and scanned once per member
with running window aggregates that give, for each anchor, the latest event on or
before it, the latest event strictly before it and the earliest event on or after
it. The window bounds are then plain column comparisons, so they may differ per
row (e.g. per cohort). Each member partition holds its anchors plus at most one
row per event day.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence, Union

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claims_cohorts.columns import DATE, INDEX, MEMBER
from claims_cohorts.operators.memberfilter import of_members

Number = Union[int, Column]


@dataclass(frozen=True)
class EventWindow:
    """Event window relative to the anchor date ``d``.

    ``lower_days``/``lower_months``: events on or after ``d - n`` (days or calendar
    months); both None means no lower bound. ``upper``: ``"before"`` (``< d``),
    ``"on"`` (``<= d``), a day count ``w`` (``<= d + w``) or None (no upper bound).
    Lower bounds must not exceed ``d`` (n >= 0).
    """

    lower_days: Number | None = None
    lower_months: Number | None = None
    upper: Union[str, Number, None] = "on"

    @staticmethod
    def symmetric(days: Number) -> "EventWindow":
        return EventWindow(lower_days=days, upper=days)

    @staticmethod
    def lookback_days(days: Number, inclusive_anchor: bool = False) -> "EventWindow":
        return EventWindow(lower_days=days, upper="on" if inclusive_anchor else "before")

    @staticmethod
    def lookback_months(months: Number) -> "EventWindow":
        return EventWindow(lower_months=months, upper="before")

    @staticmethod
    def on_or_before() -> "EventWindow":
        return EventWindow(upper="on")

    @staticmethod
    def ever() -> "EventWindow":
        return EventWindow(upper=None)


def _lit(v):
    return v if isinstance(v, Column) else F.lit(v)


def _upper_kind(upper) -> str:
    if isinstance(upper, str):
        if upper not in ("before", "on"):
            raise ValueError(f"unknown upper bound {upper!r}")
        return upper
    return "none" if upper is None else "days"


def _condition(d: Column, win: EventWindow, prev_le: Column, prev_lt: Column, next_ge: Column) -> Column:
    if win.lower_days is not None:
        lower = F.date_sub(d, _lit(win.lower_days))
    elif win.lower_months is not None:
        lower = F.add_months(d, -_lit(win.lower_months))
    else:
        lower = None

    def at_least_lower(x: Column) -> Column:
        return x.isNotNull() if lower is None else (x >= lower)

    kind = _upper_kind(win.upper)
    if kind == "before":
        cond = at_least_lower(prev_lt)
    elif kind == "on":
        cond = at_least_lower(prev_le)
    elif kind == "none":
        cond = at_least_lower(prev_le) | next_ge.isNotNull()
    else:
        cond = at_least_lower(prev_le) | (next_ge <= F.date_add(d, _lit(win.upper)))
    return d.isNotNull() & F.coalesce(cond, F.lit(False))


def window_flags(
    anchors: DataFrame,
    events: DataFrame,
    rules: dict[str, tuple[str | None, EventWindow]],
    keys: Sequence[str] = (),
    anchor_date: str = INDEX,
    event_date: str = DATE,
    role_col: str = "role",
    anchors_unique: bool = True,
    prefilter: bool = False,
) -> DataFrame:
    """Add one boolean column per rule: ``rules[name] = (role, window)``.

    With ``prefilter`` events of members without an anchor are dropped before the shuffle, by a
    filter of fixed size (``operators/memberfilter.py``). It reads the anchors a second time, so it
    pays where events are many more than the claims that the anchors come from.

    ``events`` holds (keys, member, event_date[, role]); a rule with role None uses
    all events. All rules are evaluated in one shuffle and one pass per member.
    When ``anchors_unique`` is False (e.g. claim rows, possibly many per member and
    day), flags are computed on the distinct (keys, member, day) anchors and joined
    back, so the window partitions stay bounded by calendar days.
    """
    part = [*keys, MEMBER]
    if not anchors_unique:
        base = anchors.select(*part, anchor_date).where(F.col(anchor_date).isNotNull()).distinct()
        flagged = window_flags(base, events, rules, keys, anchor_date, event_date, role_col, True, prefilter)
        out = anchors.join(flagged, [*part, anchor_date], "left")
        for name in rules:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
        return out.select(*anchors.columns, *rules)

    if prefilter:
        events = of_members(events, anchors)
    roles = sorted({r for r, _ in rules.values() if r is not None})
    use_role = bool(roles) and role_col in events.columns
    ev_cols = [*part, F.col(event_date).cast("date").alias("_t")]
    if use_role:
        ev_cols.append(F.col(role_col).alias("_role"))
    ev = events.select(*ev_cols).where(F.col("_t").isNotNull()).distinct().withColumn("_anchor", F.lit(False))
    an = anchors.withColumn("_t", F.col(anchor_date).cast("date")).withColumn("_anchor", F.lit(True))
    u = an.unionByName(ev, allowMissingColumns=True)

    order = F.unix_date(F.col("_t"))
    up = Window.partitionBy(*part).orderBy(order)
    down = Window.partitionBy(*part).orderBy(order.desc())
    cache: dict[tuple, Column] = {}

    def neighbour(kind: str, role: str | None) -> Column:
        key = (kind, role)
        if key not in cache:
            ev_t = F.col("_t")
            is_ev = ~F.col("_anchor")
            if role is not None and use_role:
                is_ev = is_ev & (F.col("_role") == role)
            val = F.when(is_ev, ev_t)
            if kind == "le":
                col = F.max(val).over(up.rangeBetween(Window.unboundedPreceding, 0))
            elif kind == "lt":
                col = F.max(val).over(up.rangeBetween(Window.unboundedPreceding, -1))
            else:
                col = F.min(val).over(down.rangeBetween(Window.unboundedPreceding, 0))
            name = f"_{kind}_{len(cache)}"
            cache[key] = (name, col)
        return F.col(cache[key][0])

    conds = {}
    for name, (role, win) in rules.items():
        kind = _upper_kind(win.upper)
        need_next = kind in ("none", "days")
        prev_le = neighbour("le", role) if kind != "before" else None
        prev_lt = neighbour("lt", role) if kind == "before" else None
        next_ge = neighbour("ge", role) if need_next else None
        conds[name] = _condition(F.col("_t"), win, prev_le, prev_lt, next_ge)
    for col_name, col in cache.values():
        u = u.withColumn(col_name, col)
    for name, cond in conds.items():
        u = u.withColumn(name, cond)
    return u.where(F.col("_anchor")).select(*anchors.columns, *rules)


def flag_rows(rows: DataFrame, is_event: Column, window: EventWindow, name: str, date_col: str = DATE) -> DataFrame:
    """Add the boolean ``name``: does the row's member have, among the rows themselves, an
    event row dated in the window around this row's date?

    For anchors and events that come from one read of the claims (rows of either kind,
    or both): one shuffle by member and running windows, no join. Rows without a member
    or a date are False, and rows without a member are spread by date.
    """
    d = F.col(date_col).cast("date")
    part = [F.col(MEMBER), F.when(F.col(MEMBER).isNull(), d)]
    up, down = Window.partitionBy(*part).orderBy(F.unix_date(d)), Window.partitionBy(*part).orderBy(F.unix_date(d).desc())
    event_day = F.when(is_event & F.col(MEMBER).isNotNull(), d)
    kind = _upper_kind(window.upper)
    prev_le = F.max(event_day).over(up.rangeBetween(Window.unboundedPreceding, 0)) if kind != "before" else None
    prev_lt = F.max(event_day).over(up.rangeBetween(Window.unboundedPreceding, -1)) if kind == "before" else None
    next_ge = F.min(event_day).over(down.rangeBetween(Window.unboundedPreceding, 0)) if kind in ("none", "days") else None
    hit = _condition(d, window, prev_le, prev_lt, next_ge)
    return rows.withColumn(name, F.coalesce(hit & d.isNotNull(), F.lit(False)))


def window_flag(
    anchors: DataFrame,
    events: DataFrame,
    window: EventWindow,
    name: str = "flag",
    keys: Sequence[str] = (),
    anchor_date: str = INDEX,
    event_date: str = DATE,
    anchors_unique: bool = True,
    prefilter: bool = False,
) -> DataFrame:
    return window_flags(anchors, events, {name: (None, window)}, keys, anchor_date, event_date, anchors_unique=anchors_unique, prefilter=prefilter)


def keep_without(
    anchors: DataFrame,
    events: DataFrame,
    window: EventWindow,
    keys: Sequence[str] = (),
    anchor_date: str = INDEX,
    event_date: str = DATE,
    anchors_unique: bool = True,
    prefilter: bool = False,
) -> DataFrame:
    """Anti filter: drop anchors having an event in the window."""
    f = window_flag(anchors, events, window, "_hit", keys, anchor_date, event_date, anchors_unique, prefilter)
    return f.where(~F.col("_hit")).drop("_hit")


def keep_with(
    anchors: DataFrame,
    events: DataFrame,
    window: EventWindow,
    keys: Sequence[str] = (),
    anchor_date: str = INDEX,
    event_date: str = DATE,
    anchors_unique: bool = True,
    prefilter: bool = False,
) -> DataFrame:
    """Semi filter: keep anchors having an event in the window."""
    f = window_flag(anchors, events, window, "_hit", keys, anchor_date, event_date, anchors_unique, prefilter)
    return f.where(F.col("_hit")).drop("_hit")


# --- named operators -------------------------------------------------------------


def exclude_within_window(
    index: DataFrame, events: DataFrame, days: Number, keys: Sequence[str] = (), prefilter: bool = False
) -> DataFrame:
    """Drop index rows with an event within ``days`` of the index date (both sides, inclusive)."""
    return keep_without(index, events, EventWindow.symmetric(days), keys, prefilter=prefilter)


def lookback_exclusion(claims: DataFrame, events: DataFrame, months: Number, keys: Sequence[str] = ()) -> DataFrame:
    """Drop claim rows (not members) with an event in ``[d - months, d)``."""
    return keep_without(claims, events, EventWindow.lookback_months(months), keys, anchor_date=DATE, anchors_unique=False)


def exclude_on_or_before(index: DataFrame, events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Drop index rows whose member has an event on or before the index date.

    Only the member's earliest event matters, so events are reduced to one row per
    member (partial aggregation) before the join.
    """
    first = (
        events.where(F.col(DATE).isNotNull())
        .groupBy(*keys, MEMBER)
        .agg(F.min(DATE).alias("_first_event"))
    )
    cond = [index[k] == first[k] for k in [*keys, MEMBER]] + [first["_first_event"] <= index[INDEX]]
    return index.join(first, cond, "left_anti")


def exclude_ever(index: DataFrame, events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Drop index rows whose member has any event at all (any date)."""
    members = events.select(*keys, MEMBER).where(F.col(MEMBER).isNotNull()).distinct()
    return index.join(members, [*keys, MEMBER], "left_anti")


def clean_period(index: DataFrame, claims: DataFrame, lookback_days: Number = 365, keys: Sequence[str] = ()) -> DataFrame:
    """Drop index rows with any claim in ``[index - lookback_days, index)``. Of all claims of the
    table, only those of index members are shuffled."""
    return keep_without(index, claims, EventWindow.lookback_days(lookback_days), keys, prefilter=True)


def symptom_flag(
    claims: DataFrame, symptom_events: DataFrame, window_days: Number, name: str = "has_symptom_code", keys: Sequence[str] = ()
) -> DataFrame:
    """Flag claim rows with a symptom claim of the member within ±``window_days``."""
    return window_flag(
        claims, symptom_events, EventWindow.symmetric(window_days), name, keys, anchor_date=DATE, anchors_unique=False
    )
