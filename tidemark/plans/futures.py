"""Futures session job, seed ingest, backtest and trailing refresh."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sessions import is_holiday, session_keys
from tidemark.operators import boundary as B
from tidemark.operators.ranking import last_sessions
from tidemark.operators.sizing import written
from tidemark.operators.trailing import trailing, trailing_against
from tidemark.operators.upsert import upsert
from tidemark.plans.options import clock
from tidemark.plans.report import FUTURES_BLOCKS, futures_report
from tidemark.settings import COTTON, FUTURES_CONTRACT_COLUMNS, FUTURES_HISTORY_COLUMNS, Market, listed

HISTORY_SCHEMA = (
    "date date, commodity string, night_total double, day_total double, full_total double, "
    "night_share double, night_day_ratio double, source string, split_source string, "
    "generated_at timestamp_ntz")
CONTRACT_SCHEMA = (
    "date date, commodity string, generic_code string, ice_code string, month_code string, "
    "month_name string, delivery_year int, position int, night double, day double, full double, "
    "generated_at timestamp_ntz")


def metric_rows(totals: DataFrame, metrics: Sequence[str] = tuple(FUTURES_BLOCKS)) -> DataFrame:
    """Wide session totals to (session_date, metric, value)."""
    m, keys = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in metrics])), session_keys(totals)
    return totals.select(*keys, m.alias("m")).select(*keys, "m.metric", "m.value")


def seed_totals(bars: DataFrame) -> DataFrame:
    """Aggregate full volume per session over whatever bars are given."""
    return bars.groupBy(*session_keys(bars)).agg(F.sum("volume").alias("full"))


def _named(df: DataFrame, commodity: str) -> DataFrame:
    """With the commodity of its rows, or the given one where the table is of one."""
    return df if "commodity" in df.columns else df.withColumn("commodity", F.lit(commodity.upper()))


def history_rows(totals: DataFrame, commodity: str, generated_at: Column) -> DataFrame:
    return _named(totals, commodity).select(
        F.col("session_date").alias("date"), "commodity",
        F.col("night").alias("night_total"), F.col("day").alias("day_total"),
        F.col("full").alias("full_total"), "night_share", "night_day_ratio", "source",
        F.lit("").alias("split_source"), generated_at.alias("generated_at"),
    ).select(*FUTURES_HISTORY_COLUMNS)


def contract_rows(contracts: DataFrame, commodity: str, generated_at: Column) -> DataFrame:
    return _named(contracts, commodity).withColumn("date", F.col("session_date")).withColumn(
        "generated_at", generated_at).select(*FUTURES_CONTRACT_COLUMNS)


class FuturesRun:
    """Results of a run, each built when it is asked for; ``writable`` is off for interim and dry runs.

    A run of several markets has its rows by commodity and date, a run of one by date.
    """

    def __init__(self, slots: DataFrame, all_slots: DataFrame, bars: DataFrame, history: DataFrame | None,
                 sessions: DataFrame | None, commodity: str, window: str, accumulate: bool, mode: str,
                 write: bool, generated_at: Column, market: Market):
        self.slots, self.all_slots, self.bars, self.prior_history = slots, all_slots, bars, history
        self.commodity, self.window, self.accumulate, self.mode = commodity, window, accumulate, mode
        self.generated_at, self.market = generated_at, market
        self.writable = write and window != "overnight"
        self._sessions = sessions
        self.keys = session_keys(slots)
        self.is_settled = False

    def named_commodity(self) -> Column:
        return F.col("commodity") if len(self.keys) > 1 else F.lit(self.commodity)

    @cached_property
    def totals(self) -> DataFrame:
        return B.session_totals(self.slots)

    @cached_property
    def sessions(self) -> DataFrame:
        return self.totals.select(*self.keys) if self._sessions is None else self._sessions

    @cached_property
    def contracts(self) -> DataFrame:
        return B.contract_rows(self.slots, self.market)

    @cached_property
    def prior(self) -> DataFrame:
        """Series the sessions are compared with: full from the bars, night and day from history."""
        computed = B.session_totals(self.all_slots)
        night_day = metric_rows(computed, ("night", "day"))
        own = night_day if self.accumulate else night_day.filter(F.lit(False))
        if self.prior_history is not None:
            mine = self.prior_history.select(
                F.upper("commodity").alias("commodity"), F.col("date").alias("session_date"), F.col("night_total").alias("night"),
                F.col("day_total").alias("day"))
            if len(self.keys) == 1:
                mine = mine.filter(F.col("commodity") == self.commodity.upper()).drop("commodity")
            old = metric_rows(mine, ("night", "day"))
            if self.accumulate:
                old = old.join(computed.select(*self.keys), self.keys, "left_anti")
            own = own.unionByName(old)
        return own.unionByName(metric_rows(seed_totals(self.bars), ("full",)))

    @cached_property
    def rvol(self) -> DataFrame:
        out = trailing_against(_named(metric_rows(self.totals), self.commodity), _named(self.prior, self.commodity),
                               ["commodity", "metric"], "session_date", "value", mode=self.mode, market=listed(self.market)[0])
        return out if len(self.keys) > 1 else out.drop("commodity")

    @cached_property
    def history(self) -> DataFrame:
        return history_rows(self.totals, self.commodity, self.generated_at)

    @cached_property
    def contract_history(self) -> DataFrame:
        return contract_rows(self.contracts, self.commodity, self.generated_at)

    def settled(self) -> "FuturesRun":
        """The same run over written slot rows, so readings and bars are not read for each result."""
        if self.is_settled:
            return self
        every = written(self.all_slots)
        slots = every if self.slots is self.all_slots else every.join(self._sessions, self.keys, "left_semi")
        run = FuturesRun(slots, every, self.bars, self.prior_history, self._sessions, self.commodity, self.window, self.accumulate, self.mode,
                         True, self.generated_at, self.market)
        run.writable, run.is_settled = self.writable, True
        return run

    @cached_property
    def report(self) -> DataFrame:
        """Lines of all blocks; eight parts of it read the slot rows, which are settled for that."""
        return self.settled()._report()

    def _report(self) -> DataFrame:
        return futures_report(self.sessions, self.totals, self.contracts, self.rvol, self.named_commodity(),
                              self.generated_at, self.window, self.market)


def futures_sessions(readings: DataFrame, bars: DataFrame, history: DataFrame | None = None, *,
                     commodity: str = "CT", dates: DataFrame | Sequence | None = None, window: str = "eod",
                     prefer_seed: bool = False, accumulate: bool = True, mode: str = "degrade",
                     write: bool = True, generated_at=None, settle: bool = False,
                     market: Market | Sequence[Market] = COTTON) -> FuturesRun:
    """Night, day and full volume of every session with readings or bars.

    ``bars`` are the cleaned daily bars (tracked slots). Full volume is compared with earlier
    bar totals, night and day with the permanent history (and, with ``accumulate``, with the
    sessions of this run). ``dates`` (a few dates, or a DataFrame of them) restricts the
    reported sessions, never the lookback. The overnight window is interim and never written. ``settle`` writes the slot rows to the
    shared folder first, for runs that feed several sinks.

    With several markets the tables have a ``commodity`` column (their prefixes; rows of others are left out), and
    so have all results; a session is then a commodity and a date. Dates given one by one are reported for each market.
    """
    if isinstance(market, Market):
        readings, bars = (df.drop("commodity") for df in (readings, bars))
    else:
        prefixes = [m.prefix for m in listed(market)]
        readings, bars = (df.filter(F.col("commodity").isin(*prefixes)) for df in (readings, bars))
    open_day = ~is_holiday(F.col("session_date"), market)
    every = B.session_slots(readings.filter(open_day), bars.filter(open_day), market, prefer_seed)
    if settle:
        every = written(every)
    slots, sessions = every, None
    if isinstance(dates, DataFrame):
        keys = session_keys(every)
        sessions = dates.select(*keys).distinct().filter(open_day)
        slots = every.join(sessions, keys, "left_semi")
    elif dates is not None:
        named = [d if isinstance(d, Column) else F.lit(d).cast("date") for d in dates]
        slots = every.filter(F.col("session_date").isin(named))
        sessions = bars.sparkSession.range(1).select(F.explode(F.array(*named)).alias("session_date"))
        if not isinstance(market, Market):
            sessions = sessions.select(F.explode(F.array(*[F.lit(p) for p in prefixes])).alias("commodity"), "session_date")
        sessions = sessions.filter(open_day)
    run = FuturesRun(slots, every, bars, history, sessions, commodity, window, accumulate, mode, write,
                     clock(generated_at), market)
    run.is_settled = settle
    return run


def document(run: FuturesRun) -> DataFrame:
    """The session file: one nested row per session with summary, contracts and ratios."""
    fields = ("ice_code", "delivery_year", "month_code", "month_name", "position", "night", "day", "full")
    # at most one entry per tracked slot
    maps = run.contracts.groupBy(*run.keys).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("generic_code", F.struct(*fields))))).alias("per_contract"))
    return run.totals.join(maps, run.keys).select(
        "session_date", F.date_format("session_date", "yyyy-MM-dd").alias("date"),
        run.named_commodity().alias("commodity"), F.lit(run.window).alias("window"),
        F.struct("source", "night", "day", "full", "per_contract").alias("summary"),
        F.struct("night_share", "night_day_ratio").alias("ratios"),
        F.date_format(run.generated_at, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"))


def seed_ingest(bars: DataFrame, commodity: str = "CT", generated_at=None,
                market: Market = COTTON) -> tuple[DataFrame, DataFrame]:
    """All bar dates as (session history rows, by-contract history rows); full only."""
    at = clock(generated_at)
    slots = B.seed_slots(bars, market).withColumn("source", F.lit(B.SOURCE_SEED))
    contracts = B.contract_rows(slots, market)
    totals = B.session_totals(slots)
    return history_rows(totals, commodity, at), contract_rows(contracts, commodity, at)


def backtest(readings: DataFrame, bars: DataFrame, n: int, **options) -> FuturesRun:
    """Dry run over the last n bar sessions."""
    return futures_sessions(readings, bars, dates=last_sessions(bars, n), write=False, **options)


def refresh_bars(bars: DataFrame, pulled: DataFrame, as_of: Column, days: int = 15) -> DataFrame:
    """Merge a re-pull of the trailing calendar days into the bars by (date, generic)."""
    recent = pulled.filter((F.col("session_date") >= F.date_sub(as_of, days)) & (F.col("session_date") <= as_of))
    return upsert(bars, recent, ["session_date", "generic"])


def refresh(readings: DataFrame, bars: DataFrame, pulled: DataFrame, as_of: Column, days: int = 15,
            **options) -> tuple[DataFrame, FuturesRun]:
    """Trailing refresh: merged bars, and the previous session recomputed from them."""
    merged = refresh_bars(bars, pulled, as_of, days)
    return merged, futures_sessions(readings, merged, dates=[F.date_sub(as_of, 1)], **options)


def tilt_rvol(totals: DataFrame, mode: str = "degrade", market: Market = COTTON) -> DataFrame:
    """Night share and night/day ratio against their own trailing sessions."""
    return trailing(metric_rows(totals, ("night_share", "night_day_ratio")), [*session_keys(totals)[:-1], "metric"], "session_date",
                    "value", mode=mode, market=market)


def contract_rvol(contracts: DataFrame, mode: str = "degrade", market: Market = COTTON) -> DataFrame:
    """Night, day and full of every contract against its own trailing sessions."""
    m = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value"))
                            for x in FUTURES_BLOCKS]))
    keys = session_keys(contracts)
    long = contracts.select(*keys, "generic_code", m.alias("m")).select(*keys, "generic_code", "m.metric", "m.value")
    return trailing(long, [*keys[:-1], "generic_code", "metric"], "session_date", "value", mode=mode, market=market)
