"""Session calendar predicates. Clocks are always arguments, never the machine's."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import falls_on_holiday, holidays
from tidemark.functions.parsing import at_clock
from tidemark.settings import COTTON, Market, listed


def session_keys(df: DataFrame) -> list[str]:
    """What names a session of ``df``: its date, and its commodity where rows of several are in one table."""
    return ["commodity", "session_date"] if "commodity" in df.columns else ["session_date"]


def per_market(make: Callable[[Market], Column], market: Market | Sequence[Market]) -> Column:
    """The column ``make`` gives for a market; of several, that of the row's ``commodity``, null for another."""
    if isinstance(market, Market):
        return make(market)
    first, *rest = listed(market)
    out = F.when(F.col("commodity") == first.prefix, make(first))
    for m in rest:
        out = out.when(F.col("commodity") == m.prefix, make(m))
    return out


def is_holiday(day: Column, market: Market | Sequence[Market] = COTTON) -> Column:
    if not isinstance(market, Market):
        return F.coalesce(per_market(lambda m: is_holiday(day, m), market), F.lit(False))
    if market.holiday_rules:
        return falls_on_holiday(day, market)
    if not market.closed_dates:
        return F.lit(False)
    return F.array_contains(F.expr(f"array({', '.join(f"date'{d}'" for d in market.closed_dates)})"), day)


def is_closed(day: Column, market: Market = COTTON) -> Column:
    """Weekend or holiday."""
    return (F.weekday(day) >= 5) | is_holiday(day, market)


def boundary_time(boundary: Column, session_date: Column, market: Market = COTTON) -> Column:
    """Absolute time of a boundary; the open lies on the previous calendar day."""
    first, second, third = market.boundaries
    return (
        F.when(boundary == first, at_clock(session_date, *market.session_open, prev_day=True))
        .when(boundary == second, at_clock(session_date, *market.day_start))
        .when(boundary == third, at_clock(session_date, *market.day_end))
    )


def is_due(boundary: Column, session_date: Column, as_of: Column, market: Market = COTTON,
           force_all: bool = False) -> Column:
    """Should the reading exist by ``as_of``? Past sessions owe all, future ones nothing."""
    if force_all:
        return F.lit(True)
    grace = F.expr(f"INTERVAL '{market.grace_minutes}' MINUTE")
    today = as_of.cast("date")
    opened = boundary == market.boundaries[0]
    passed = as_of >= boundary_time(boundary, session_date, market) + grace
    return (session_date < today) | ((session_date == today) & (opened | passed))


def next_business_day(day: Column, market: Market = COTTON) -> Column:
    """First open day after ``day``: the next weekday, moved on where that is a holiday."""
    if market.holiday_rules:
        near = F.sequence(F.date_add(day, 1), F.date_add(day, 14))  # no market is closed for two weeks
        closed = F.concat(holidays(F.year(day), market), holidays(F.year(F.date_add(day, 14)), market))
        return F.filter(near, lambda d: (F.weekday(d) < 5) & ~F.array_contains(closed, d))[0]
    ahead = F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1)
    weekday = F.date_add(day, ahead)
    moved = {h: _first_open(h, market) for h in market.closed_dates}
    if not moved:
        return weekday
    table = F.expr(f"map({', '.join(f"date'{d}'" for pair in moved.items() for d in pair)})")
    return F.coalesce(F.try_element_at(table, weekday), weekday)


def _first_open(holiday: str, market: Market) -> date:
    closed = set(market.closed_dates)
    d = date.fromisoformat(holiday)
    while d.weekday() >= 5 or d.isoformat() in closed:
        d += timedelta(days=1)
    return d
