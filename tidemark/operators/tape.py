"""Window volumes from a cumulative options tape.

A tape row is (session_date, snap_ts, contract, call_vol, put_vol, ...): the cumulative
volume of one strike at one poll. A window reads ONE poll for the whole tape, the latest
at or before its cutoff, so a contract that is silent in that poll contributes nothing.

The plan for any number of sessions is two scans: one over (session_date, snap_ts) that
reduces to a row per session before it is shuffled, and one that keeps only the rows of the
chosen polls before summing them per slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import clamp, ratio, window_cutoff
from tidemark.functions.sessions import per_market, session_keys
from tidemark.functions.symbology import computed, option_slot
from tidemark.settings import COTTON, Market, listed

WINDOWS = ("overnight", "day")


def snapshots(tape: DataFrame) -> DataFrame:
    """Distinct polls per session."""
    return tape.select(*session_keys(tape), "snap_ts").filter(F.col("snap_ts").isNotNull()).distinct()


def sessions(tape: DataFrame) -> DataFrame:
    """Session dates that have a tape, with the number of polls and their extent."""
    return (
        snapshots(tape)
        .groupBy(*session_keys(tape))
        .agg(F.count("*").alias("n_snapshots"),
             F.min("snap_ts").alias("first_ts"), F.max("snap_ts").alias("last_ts"))
    )


def latest_session(tape: DataFrame) -> DataFrame:
    return tape.agg(F.max("session_date").alias("session_date"))


def last_at_or_before(tape: DataFrame, cutoffs: dict[str, Column]) -> DataFrame:
    """Per session, the latest poll at or before each cutoff (null when there is none)."""
    ts = F.col("snap_ts")
    return tape.groupBy(*session_keys(tape)).agg(
        *[F.max(F.when(ts <= cutoff, ts)).alias(name) for name, cutoff in cutoffs.items()]
    )


def marks(tape: DataFrame, market: Market | Sequence[Market] = COTTON) -> DataFrame:
    """The polls that define both windows; the day needs two different ones."""
    day, market = F.col("session_date"), listed(market)[0]  # those of one plan share their windows
    found = last_at_or_before(tape, {
        "overnight_ts": window_cutoff(day, market.overnight_end, inclusive=False),
        "start_ts": window_cutoff(day, market.day_start),
        "end_ts": window_cutoff(day, market.day_end),
    })
    has_day = F.col("start_ts") < F.col("end_ts")
    return found.select(
        *session_keys(tape), "overnight_ts",
        F.when(has_day, F.col("start_ts")).alias("day_start_ts"),
        F.when(has_day, F.col("end_ts")).alias("day_end_ts"),
    )


def _at_marks(tape: DataFrame, marked: DataFrame) -> DataFrame:
    """Tape rows of the chosen polls only, found by session and poll time.

    The marks become a row per poll, so both columns are join keys: a session splits by its polls
    and the rows of other polls find no partner.
    """
    polls = F.array_distinct(F.array_compact(F.array("overnight_ts", "day_start_ts", "day_end_ts")))
    side, keys = marked.select("*", F.explode(polls).alias("snap_ts")), session_keys(tape)
    return tape.select(*keys, "snap_ts", "contract", "call_vol", "put_vol").join(side, [*keys, "snap_ts"])


def window_slots(tape: DataFrame, market: Market | Sequence[Market] = COTTON, tracked_only: bool = True,
                 marked: DataFrame | None = None) -> DataFrame:
    """(session_date, window, generic_code, call, put, total) for both windows, with the commodity if the tape has it.

    Overnight is the cumulative at its poll; the day is end minus start per slot, a side that
    is missing counting 0, clamped at 0. With ``tracked_only`` off, contracts outside the
    slots stay as rows of their own and a ``tracked`` column tells them apart.
    """
    at_marks = _at_marks(tape, marks(tape, market) if marked is None else marked)
    keys = session_keys(tape)
    rows = computed(at_marks, slot=per_market(lambda m: option_slot(F.col("contract"), F.col("session_date"), m), market))
    tracked = F.col("slot").isNotNull()
    if tracked_only:
        rows = rows.filter(tracked)
    rows = rows.withColumn("tracked", tracked).withColumn(
        "generic_code", F.coalesce("slot", "contract", F.lit("")))

    ts = F.col("snap_ts")

    def at(mark: str, value: str) -> Column:
        return F.sum(F.when(ts == F.col(mark), F.coalesce(F.col(value), F.lit(0.0))))

    sums = rows.groupBy(*keys, "generic_code", "tracked").agg(
        at("overnight_ts", "call_vol").alias("on_call"), at("overnight_ts", "put_vol").alias("on_put"),
        at("day_start_ts", "call_vol").alias("s_call"), at("day_start_ts", "put_vol").alias("s_put"),
        at("day_end_ts", "call_vol").alias("e_call"), at("day_end_ts", "put_vol").alias("e_put"),
    )

    def moved(end: str, start: str) -> Column:
        either = F.col(end).isNotNull() | F.col(start).isNotNull()
        zero = F.lit(0.0)
        return F.when(either, clamp(F.coalesce(end, zero) - F.coalesce(start, zero)))

    per_window = F.explode(F.array(
        F.struct(F.lit("overnight").alias("window"), F.col("on_call").alias("call"),
                 F.col("on_put").alias("put")),
        F.struct(F.lit("day").alias("window"), moved("e_call", "s_call").alias("call"),
                 moved("e_put", "s_put").alias("put")),
    ))
    out = (
        sums.select(*keys, "generic_code", "tracked", per_window.alias("w"))
        .filter(F.col("w.call").isNotNull())
        .select(*keys, F.col("w.window").alias("window"), "generic_code", "tracked",
                F.col("w.call").alias("call"), F.col("w.put").alias("put"),
                (F.col("w.call") + F.col("w.put")).alias("total"))
    )
    return out.drop("tracked") if tracked_only else out


def window_marks(marked: DataFrame) -> DataFrame:
    """One row per (session, window) that exists, with the polls it was read at."""
    w = F.explode(F.array(
        F.struct(F.lit("overnight").alias("window"), F.lit(None).cast("timestamp_ntz").alias("start"),
                 F.col("overnight_ts").alias("end")),
        F.struct(F.lit("day").alias("window"), F.col("day_start_ts").alias("start"),
                 F.col("day_end_ts").alias("end")),
    )).alias("w")
    return (
        marked.select(*session_keys(marked), w).filter(F.col("w.end").isNotNull())
        .select(*session_keys(marked), F.col("w.window").alias("window"),
                F.col("w.start").alias("snapshot_ts_start"), F.col("w.end").alias("snapshot_ts"))
    )


def window_totals(slots: DataFrame, marked: DataFrame) -> DataFrame:
    """Totals per (session, window). A window that has its polls but no tracked volume is 0."""
    zero, keys = F.lit(0.0), [*session_keys(slots), "window"]
    base = window_marks(marked).select(
        *keys, zero.alias("call"), zero.alias("put"),
        "snapshot_ts_start", "snapshot_ts")
    sums = base.unionByName(
        slots.select(*keys, "call", "put"), allowMissingColumns=True
    ).groupBy(*keys).agg(
        F.sum("call").alias("call"), F.sum("put").alias("put"),
        F.max("snapshot_ts_start").alias("snapshot_ts_start"),
        F.max("snapshot_ts").alias("snapshot_ts"),
    )
    return sums.select(
        *keys, (F.col("call") + F.col("put")).alias("total"), "call", "put",
        ratio(F.col("put"), F.col("call")).alias("pc_ratio"), "snapshot_ts_start", "snapshot_ts",
    )


def full_window(totals: DataFrame) -> DataFrame:
    """Overnight + day per session; a missing window adds nothing."""
    sums = totals.groupBy(*session_keys(totals)).agg(
        *[F.sum(c).alias(c) for c in ("total", "call", "put")],
        F.count("*").alias("n_windows"))
    return sums.withColumn("pc_ratio", ratio(F.col("put"), F.col("call")))


def short_sessions(tape: DataFrame, market: Market = COTTON) -> DataFrame:
    """Sessions whose last poll is earlier than the end of the day window."""
    last = tape.groupBy(*session_keys(tape)).agg(F.max("snap_ts").alias("last_ts"))
    end = window_cutoff(F.col("session_date"), market.day_end, inclusive=False)
    return last.withColumn("is_short", F.col("last_ts") < end)


def filter_impact(tape: DataFrame, market: Market = COTTON) -> DataFrame:
    """Per (session, window): volume of every contract next to volume of the tracked slots.

    Both views come from one aggregate, so they cost one pass over the tape.
    """
    def kept(c: str) -> Column:
        return F.sum(F.when(F.col("tracked"), F.col(c)).otherwise(0.0)).alias(f"{c}_universe")

    return window_slots(tape, market, tracked_only=False).groupBy(*session_keys(tape), "window").agg(
        F.sum("total").alias("total"), F.sum("call").alias("call"), F.sum("put").alias("put"),
        kept("total"), kept("call"), kept("put"),
    ).withColumn("dropped", F.col("total") - F.col("total_universe"))
