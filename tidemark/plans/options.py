"""Options session job: any number of sessions in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.functions.sessions import is_holiday, per_market, session_keys
from tidemark.functions.symbology import enrich
from tidemark.operators import tape as T
from tidemark.operators.sizing import written
from tidemark.operators.trailing import as_map, trailing, trailing_against
from tidemark.plans.report import options_report
from tidemark.settings import COTTON, Market, listed

HISTORY_SCHEMA = (
    "date date, commodity string, overnight_total double, overnight_call double, overnight_put double, "
    "overnight_pc_ratio double, overnight_snapshot_ts timestamp_ntz, day_total double, day_call double, "
    "day_put double, day_pc_ratio double, day_snapshot_ts_start timestamp_ntz, "
    "day_snapshot_ts_end timestamp_ntz, generated_at timestamp_ntz")


def clock(generated_at) -> Column:
    if generated_at is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return generated_at if isinstance(generated_at, Column) else F.lit(generated_at).cast("timestamp_ntz")


def history_series(history: DataFrame) -> DataFrame:
    """Wide history rows to (session_date, window, total), blanks dropped."""
    w = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"{n}_total").alias("total"))
                            for n in T.WINDOWS])).alias("w")
    return history.select("commodity", F.col("date").alias("session_date"), w).select(
        "commodity", "session_date", "w.window", "w.total").filter(F.col("total").isNotNull())


def history_rows(sessions: DataFrame, totals: DataFrame, commodity: str, generated_at: Column) -> DataFrame:
    """One wide row per session; a window without data stays blank."""
    def of(window: str, c: str) -> Column:
        return F.max(F.when(F.col("window") == window, F.col(c)))

    keys = session_keys(sessions)
    base = sessions.select(*keys).unionByName(totals, allowMissingColumns=True)
    wide = base.groupBy(*keys).agg(
        *[of(w, c).alias(f"{w}_{c}") for w in T.WINDOWS for c in ("total", "call", "put", "pc_ratio")],
        of("overnight", "snapshot_ts").alias("overnight_snapshot_ts"),
        of("day", "snapshot_ts_start").alias("day_snapshot_ts_start"),
        of("day", "snapshot_ts").alias("day_snapshot_ts_end"))
    return wide.select(
        F.col("session_date").alias("date"), (F.col("commodity") if len(keys) > 1 else F.lit(commodity.upper())).alias("commodity"),
        "overnight_total", "overnight_call", "overnight_put", "overnight_pc_ratio", "overnight_snapshot_ts",
        "day_total", "day_call", "day_put", "day_pc_ratio", "day_snapshot_ts_start", "day_snapshot_ts_end",
        generated_at.alias("generated_at"))


class OptionsRun:
    """Results of a run, each built when it is asked for. Nothing is written until a sink is called.

    A run of several markets has its rows by commodity and date, a run of one by date.
    """

    def __init__(self, marked: DataFrame, slots: DataFrame, history: DataFrame | None, commodity: str,
                 windows: Sequence[str], accumulate: bool, mode: str, generated_at: Column, market: Market | Sequence[Market]):
        self.marked, self.slots, self.prior_history = marked, slots, history
        self.commodity, self.windows, self.accumulate, self.mode = commodity, tuple(windows), accumulate, mode
        self.generated_at, self.market = generated_at, market
        self.keys = session_keys(marked)
        self.sessions = marked.select(*self.keys)
        self.listed: DataFrame | None = None
        self.tape: DataFrame | None = None
        self.is_settled = False

    def named_commodity(self) -> Column:
        return F.col("commodity") if len(self.keys) > 1 else F.lit(self.commodity)

    @cached_property
    def totals(self) -> DataFrame:
        marks = (("overnight", "overnight_ts"), ("day", "day_start_ts"), ("day", "day_end_ts"))
        wanted = [F.col(c) if w in self.windows else F.lit(None).cast("timestamp_ntz").alias(c) for w, c in marks]
        return T.window_totals(self.slots, self.marked.select(*self.keys, *wanted))

    @cached_property
    def rvol(self) -> DataFrame:
        """Totals against the permanent history, and this run's earlier sessions if they count."""
        named = len(self.keys) > 1
        mine = F.col("commodity") if named else F.lit(self.commodity.upper())
        current = self.totals.select(mine.alias("commodity"), "session_date", "window", "total")
        series, market = ["commodity", "window"], listed(self.market)[0]
        if self.prior_history is None and self.accumulate:
            out = trailing(current, series, "session_date", "total", mode=self.mode, market=market)
        else:
            prior = current.filter(F.lit(False))
            if self.prior_history is not None:
                prior = history_series(self.prior_history.withColumn("commodity", F.upper("commodity")))
                prior = prior if named else prior.filter(F.col("commodity") == self.commodity.upper())
                if self.accumulate:
                    prior = prior.join(self.sessions, self.keys, "left_anti").unionByName(current)
            out = trailing_against(current, prior, series, "session_date", "total", mode=self.mode, market=market)
        return out if named else out.drop("commodity")

    @cached_property
    def status(self) -> DataFrame:
        """Code 1 for a listed session of which no poll could be read; missing windows only warn."""
        if self.listed is None:
            marked = self.marked.withColumn("was_read", F.lit(True))
        else:
            there = self.listed.select(*self.keys).filter(~is_holiday(F.col("session_date"), self.market))
            marked = there.unionByName(self.marked.select(*self.keys)).distinct() \
                .join(self.marked, self.keys, "left") \
                .join(T.snapshots(self.tape).select(*self.keys, F.lit(True).alias("was_read")).distinct(), self.keys, "left")
        no_overnight, no_day = F.col("overnight_ts").isNull(), F.col("day_end_ts").isNull()
        unread = F.col("was_read").isNull()
        return marked.select(
            *self.keys, (~no_overnight).alias("has_overnight"), (~no_day).alias("has_day"),
            unread.cast("int").alias("code"),
            F.when(unread, "no readable poll").otherwise(F.concat_ws(
                "; ", F.when(no_overnight, "no overnight snapshot"), F.when(no_day, "no day snapshots"))).alias("warning"))

    @cached_property
    def history(self) -> DataFrame:
        return history_rows(self.sessions, self.totals, self.commodity, self.generated_at)

    def settled(self) -> "OptionsRun":
        """The same run over written marks and slot rows (a few for each session), so the tape is not read for each result."""
        if self.is_settled:
            return self
        run = OptionsRun(written(self.marked), written(self.slots), self.prior_history, self.commodity, self.windows, self.accumulate,
                         self.mode, self.generated_at, self.market)
        run.listed, run.tape, run.is_settled = self.listed, self.tape, True
        return run

    @cached_property
    def report(self) -> DataFrame:
        """Lines of all blocks; eight parts of it read the slot rows, which are settled for that."""
        return self.settled()._report()

    def _report(self) -> DataFrame:
        return options_report(self.sessions, self.totals, self.slots, self.rvol, self.named_commodity(),
                              self.generated_at, self.windows, self.market)


def options_sessions(tape: DataFrame, history: DataFrame | None = None, *, commodity: str = "CT",
                     windows: Sequence[str] = T.WINDOWS, dates: Sequence[str] | None = None,
                     accumulate: bool = True, mode: str = "degrade", generated_at=None,
                     settle: bool = False, market: Market | Sequence[Market] = COTTON, listed: DataFrame | None = None) -> OptionsRun:
    """Window volumes, totals, trailing comparison, report and history rows of the sessions.

    ``dates`` limits the sessions (and prunes the tape's partitions); without it every tape
    is processed. Holidays produce nothing. ``accumulate`` lets sessions of this run count as
    history of later ones, as when they are processed and written one after another.
    ``settle`` writes the slot-grain results to the shared folder first: use it when several
    sinks follow, so the tape is scanned once however many results are written. ``listed`` names the
    sessions that have a tape file, so that one without a readable poll shows in the status; it
    never stops the others.

    With several markets the tape has a ``commodity`` column (their prefixes; rows of others are left out), and so
    have all results; the commodity is part of every key.
    """
    if isinstance(market, Market):
        tape = tape.drop("commodity")
    else:
        tape = tape.filter(F.col("commodity").isin(*[m.prefix for m in settings.listed(market)]))
    if dates is not None:
        tape = tape.filter(F.col("session_date").isin([F.lit(d).cast("date") for d in dates]))
    tape = tape.filter(~is_holiday(F.col("session_date"), market))
    marked = T.marks(tape, market)
    if settle:
        marked = written(marked)
    slots = T.window_slots(tape, market, marked=marked if settle else None).filter(F.col("window").isin(list(windows)))
    if settle:
        slots = written(slots)
    run = OptionsRun(marked, slots, history, commodity, windows, accumulate, mode, clock(generated_at), market)
    run.listed, run.tape, run.is_settled = listed, tape, settle
    return run


def contract_history(run: OptionsRun) -> DataFrame:
    """Permanent per-contract rows keyed by (session_date, window, generic_code)."""
    named = enrich(run.slots, "generic_code", "session_date", run.market)
    return named.select(*run.keys, "generic_code", "ice_code", "month_code", "month_name",
                        "delivery_year", "window", "total", "call", "put")


def payload(run: OptionsRun) -> DataFrame:
    """One nested row per session: windows with totals, tier map and contract array."""
    c = enrich(run.slots, "generic_code", "session_date", run.market)
    fields = ("generic_code", "ice_code", "month_code", "month_name", "delivery_year", "total", "call", "put")
    # at most one entry per tracked slot
    keys = [*run.keys, "window"]
    arrays = c.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("by_contract"))
    tiers = as_map(run.rvol, keys)
    body = run.totals.join(arrays, keys, "left").join(tiers, keys, "left")
    block = F.struct("snapshot_ts_start", "snapshot_ts", "total", "call", "put", "pc_ratio", "rvol",
                     F.coalesce("by_contract", F.array().cast(arrays.schema["by_contract"].dataType))
                     .alias("by_contract"))
    per = run.sessions.unionByName(body.select(*keys, block.alias("block")), allowMissingColumns=True)
    one = per.groupBy(*run.keys).agg(F.struct(*[
        F.first(F.when(F.col("window") == w, F.col("block")), ignorenulls=True).alias(w)
        for w in T.WINDOWS]).alias("windows"))
    excluded = per_market(lambda m: F.array(*[F.lit(p) for p in m.excluded_prefixes]).cast("array<string>"), run.market)
    return one.select("session_date", run.named_commodity().alias("commodity"), "windows", excluded.alias("excluded"),
                      run.generated_at.alias("generated_at"))


def document(run: OptionsRun) -> DataFrame:
    """The session file: one nested row per session, a window without data being null."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    fields = ("ice_code", "delivery_year", "month_code", "month_name", "call", "put", "total")
    c = enrich(run.slots, "generic_code", "session_date", run.market)
    # at most one entry per tracked slot
    maps = c.groupBy(*run.keys, "window").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("generic_code", F.struct(*fields))))).alias("per_contract"))
    body = run.totals.join(maps, [*run.keys, "window"], "left")
    common = ["total", "call", "put", "pc_ratio", F.coalesce(
        "per_contract", F.create_map().cast(maps.schema["per_contract"].dataType)).alias("per_contract")]
    end = F.date_format("snapshot_ts", stamp)
    shapes = {"overnight": F.struct(*common, end.alias("snapshot_ts")),
              "day": F.struct(*common, F.date_format("snapshot_ts_start", stamp).alias("snapshot_ts_start"),
                              end.alias("snapshot_ts_end"))}
    blocks = body.select(*run.keys, *[F.when(F.col("window") == w, b).alias(w) for w, b in shapes.items()])
    per = run.sessions.unionByName(blocks, allowMissingColumns=True)
    one = per.groupBy(*run.keys).agg(*[F.first(w, ignorenulls=True).alias(w) for w in shapes])
    return one.select(
        "session_date", F.date_format("session_date", "yyyy-MM-dd").alias("date"),
        run.named_commodity().alias("commodity"), F.lit(_window_name(run.windows)).alias("window"), "overnight", "day",
        F.date_format(run.generated_at, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"))


def _window_name(windows: Sequence[str]) -> str:
    return windows[0] if len(windows) == 1 else "both"


def latest_pointer(payloads: DataFrame, root: str) -> DataFrame:
    """Most recent session, when it was built and where its payload lies."""
    last = payloads.agg(F.max("session_date").alias("session_date"),
                        F.max_by("generated_at", "session_date").alias("generated_at"))
    day = F.date_format("session_date", "yyyy-MM-dd")
    return last.select("session_date", "generated_at",
                       F.concat(F.lit(f"{root}/session_date="), day).alias("path"))
