"""Typed parameters of a market: windows, slots, exclusions, lookback tiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

# Exchange month letters in calendar order, month words and names.
MONTH_LETTERS = "FGHJKMNQUVXZ"
MONTH_WORDS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
MONTH_NAMES = tuple(w.capitalize() for w in MONTH_WORDS)

# Column order of the boundary sidecar, the daily bars and the histories.
SIDECAR_COLUMNS = ("timestamp", "date", "commodity", "contract", "boundary", "volume", "oi")
BAR_COLUMNS = (
    "date", "generic", "ticker", "volume", "open_int",
    "px_last", "px_high", "px_low", "px_open", "efp_volume", "efs_volume",
)
OPTION_HISTORY_COLUMNS = (
    "date", "commodity",
    "overnight_total", "overnight_call", "overnight_put", "overnight_pc_ratio",
    "overnight_snapshot_ts",
    "day_total", "day_call", "day_put", "day_pc_ratio",
    "day_snapshot_ts_start", "day_snapshot_ts_end",
    "generated_at",
)
FUTURES_HISTORY_COLUMNS = (
    "date", "commodity", "night_total", "day_total", "full_total",
    "night_share", "night_day_ratio", "source", "split_source", "generated_at",
)
FUTURES_CONTRACT_COLUMNS = (
    "date", "commodity", "generic_code", "ice_code", "month_code", "month_name",
    "delivery_year", "position", "night", "day", "full", "generated_at",
)

# Labels of the two futures volume sources.
SOURCE_LIVE = "live"
SOURCE_SEED = "seed"


@dataclass(frozen=True)
class HolidayRule:
    """A holiday of each year from ``since`` on.

    ``fixed``: month and day, moved from Sunday to Monday, and from Saturday to Friday if ``saturday``. ``weekday``: the
    ``nth`` weekday ``day`` (Monday 0) of the month, the last one for -1. ``easter``: ``day`` days after Easter Sunday.
    """

    kind: str
    month: int = 0
    day: int = 0
    nth: int = 0
    since: int = 0
    saturday: bool = True


# Holidays of the exchange, in the order of the year. A New Year's Day on a Saturday is not made up for.
US_EXCHANGE = (
    HolidayRule("fixed", month=1, day=1, saturday=False),
    HolidayRule("weekday", month=1, day=0, nth=3, since=1998),
    HolidayRule("weekday", month=2, day=0, nth=3),
    HolidayRule("easter", day=-2),
    HolidayRule("weekday", month=5, day=0, nth=-1),
    HolidayRule("fixed", month=6, day=19, since=2022),
    HolidayRule("fixed", month=7, day=4),
    HolidayRule("weekday", month=9, day=0, nth=1),
    HolidayRule("weekday", month=11, day=3, nth=4),
    HolidayRule("fixed", month=12, day=25),
)


@dataclass(frozen=True)
class Market:
    """Everything that distinguishes one commodity from another. Defaults: cotton."""

    prefix: str = "CT"
    # Delivery months that make up the slots.
    active_months: tuple[str, ...] = ("MAR", "MAY", "JUL", "DEC")
    positions: tuple[int, ...] = (1, 2)
    # Months never counted, as exchange prefix and as generic prefix.
    excluded_prefixes: tuple[str, ...] = ("CTV", "CTQ")
    excluded_generics: tuple[str, ...] = ("CTOCT", "CTAUG")
    # Serial option month -> futures month it settles into.
    serial_parents: tuple[tuple[str, str], ...] = (("CTU", "CTZ"), ("CTX", "CTZ"), ("CTF", "CTH"))
    # Exchange holidays of 2026. Other years come from ``holiday_rules``, or none where there are none.
    closed_dates: tuple[str, ...] = (
        "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25",
        "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
    )
    holiday_rules: tuple[HolidayRule, ...] = ()
    tiers: tuple[int, ...] = (5, 10, 20, 30, 60)
    high: float = 2.0
    low: float = 0.5
    # (hour, minute) on the session date; the session opens on the previous day.
    session_open: tuple[int, int] = (21, 0)
    overnight_end: tuple[int, int] = (7, 0)
    day_start: tuple[int, int] = (7, 0)
    day_end: tuple[int, int] = (14, 20)
    boundaries: tuple[str, ...] = ("open", "0700", "1420")
    grace_minutes: int = 5

    @property
    def slots(self) -> tuple[str, ...]:
        return tuple(f"{self.prefix}{w}{p}" for w in self.active_months for p in self.positions)


COTTON = Market()


def listed(market: Market | Sequence[Market]) -> tuple[Market, ...]:
    """One market or several of one plan; these may differ in prefix, months, exclusions and holidays only."""
    markets = (market,) if isinstance(market, Market) else tuple(market)
    shared = {(m.tiers, m.high, m.low, m.session_open, m.overnight_end, m.day_start, m.day_end, m.boundaries, m.grace_minutes) for m in markets}
    if len(shared) != 1 or len({m.prefix for m in markets}) != len(markets):
        raise ValueError("markets of one plan share their windows, boundaries and tiers, and differ in their prefix")
    return markets
