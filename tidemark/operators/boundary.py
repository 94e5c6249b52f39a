"""Night, day and full volume from three cumulative boundary readings per contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import clamp, clean_code, ratio
from tidemark.functions.sessions import boundary_time, per_market, session_keys
from tidemark.functions.symbology import boundary_slot, computed, enrich
from tidemark.settings import COTTON, SOURCE_LIVE, SOURCE_SEED, Market, listed


def pivot_boundaries(readings: DataFrame, market: Market | Sequence[Market] = COTTON) -> DataFrame:
    """One row per (session, contract); the last non-null reading of a boundary wins.

    ``seq`` is the position of a reading in its file, recorded when it was scanned. A session is a date, or a
    commodity and a date with several markets.
    """
    keys, market = _keys(readings, market), listed(market)[0]  # those of one plan share their boundaries
    label = F.trim("boundary")
    rows = readings.withColumn("contract", clean_code(F.col("contract"))).filter(
        (F.col("contract") != "") & label.isin(*market.boundaries) & F.col("volume").isNotNull())

    def last(name: str) -> Column:
        hit = label == name
        return F.max_by(F.when(hit, F.col("volume")), F.when(hit, F.col("seq")))

    v_open, v_mid, v_end = market.boundaries
    return rows.groupBy(*keys, "contract").agg(
        last(v_open).alias("v_open"), last(v_mid).alias("v_mid"), last(v_end).alias("v_end"))


def _keys(df: DataFrame, market: Market | Sequence[Market]) -> list[str]:
    """What names a session: with one market its date, also where the table has a commodity column."""
    return ["session_date"] if isinstance(market, Market) else ["commodity", "session_date"]


def boundary_windows(readings: DataFrame, market: Market | Sequence[Market] = COTTON) -> DataFrame:
    """(session_date, generic_code, night, day, full) of contracts with all three readings.

    Where an exchange code and a slot name describe the same slot, the exchange code wins.
    """
    complete = pivot_boundaries(readings, market).filter(
        F.col("v_open").isNotNull() & F.col("v_mid").isNotNull() & F.col("v_end").isNotNull())
    keys = _keys(readings, market)
    slot = per_market(lambda m: boundary_slot(F.col("contract"), F.col("session_date"), m), market)
    volumes = computed(complete, generic_code=slot).select(
        *keys, "contract", "generic_code",
        clamp(F.col("v_mid") - F.col("v_open")).alias("night"),
        clamp(F.col("v_end") - F.col("v_mid")).alias("day"),
    ).withColumn("full", F.col("night") + F.col("day"))
    kept = volumes.filter(F.col("generic_code").isNotNull() & (F.col("full") > 0))
    by_exchange_code = (F.col("contract") != F.col("generic_code")).cast("int")
    return kept.groupBy(*keys, "generic_code").agg(
        *[F.max_by(c, by_exchange_code).alias(c) for c in ("night", "day", "full")])


def seed_slots(bars: DataFrame, market: Market | Sequence[Market] = COTTON) -> DataFrame:
    """Daily bars as full-only slot rows; night and day are unknown."""
    unknown = F.lit(None).cast("double")
    tracked = per_market(lambda m: F.col("generic").isin(*m.slots), market)
    return bars.filter(tracked).select(
        *_keys(bars, market), F.col("generic").alias("generic_code"),
        unknown.alias("night"), unknown.alias("day"), F.col("volume").alias("full"))


def prefer(first: DataFrame, first_label: str, second: DataFrame, second_label: str) -> DataFrame:
    """Per session: all slot rows of ``first``, or those of ``second`` where it has none."""
    keys = session_keys(first)
    covered = first.select(*keys).distinct()
    return first.withColumn("source", F.lit(first_label)).unionByName(
        second.join(covered, keys, "left_anti").withColumn("source", F.lit(second_label)))


def session_slots(readings: DataFrame, bars: DataFrame, market: Market | Sequence[Market] = COTTON,
                  prefer_seed: bool = False) -> DataFrame:
    """Live readings first, daily bars where a session has none (or the other way round)."""
    live = boundary_windows(readings, market)
    seed = seed_slots(bars, market)
    if prefer_seed:
        return prefer(seed, SOURCE_SEED, live, SOURCE_LIVE)
    return prefer(live, SOURCE_LIVE, seed, SOURCE_SEED)


def tilt(totals: DataFrame) -> DataFrame:
    """Night share and night/day ratio, null where undefined."""
    return totals.withColumn("night_share", ratio(F.col("night"), F.col("full"))).withColumn(
        "night_day_ratio", ratio(F.col("night"), F.col("day")))


def session_totals(slots: DataFrame) -> DataFrame:
    """Null-aware totals per session: null only when every input is null."""
    return tilt(slots.groupBy(*session_keys(slots), "source").agg(
        F.sum("night").alias("night"), F.sum("day").alias("day"), F.sum("full").alias("full"),
        F.count("*").alias("n_contracts")))


def contract_rows(slots: DataFrame, market: Market | Sequence[Market] = COTTON) -> DataFrame:
    return enrich(slots, "generic_code", "session_date", market)


def _first_readings(market: Market) -> list[Column]:
    """Per boundary the first poll on or after its time, as plain columns (hash-aggregated).

    All three aggregates see the same rows in the same order and compare the same time, so they
    keep the same poll also where two polls have one time.
    Boundary times are absolute, so the evening open never triggers the morning boundaries.
    """
    ts = F.col("snap_ts")
    out = []
    for b in market.boundaries:
        at = F.when(ts >= boundary_time(F.lit(b), F.col("session_date"), market), ts)
        out += [F.min(at).alias(f"ts_{b}"), F.min_by("volume", at).alias(f"volume_{b}"),
                F.min_by("oi", at).alias(f"oi_{b}")]
    return out


def _reading_rows(wide: DataFrame, market: Market) -> DataFrame:
    rows = F.explode(F.array(*[
        F.struct(F.lit(b).alias("boundary"), F.col(f"ts_{b}").alias("timestamp"),
                 F.col(f"volume_{b}").alias("volume"), F.col(f"oi_{b}").alias("oi"))
        for b in market.boundaries])).alias("r")
    return wide.select("session_date", "contract", rows).select("session_date", "contract", "r.*").filter(
        F.col("timestamp").isNotNull())


def useful_polls(polls: DataFrame) -> DataFrame:
    """Polls with neither volume nor open interest are not readings."""
    return polls.filter(F.col("volume").isNotNull() | F.col("oi").isNotNull())


def capture_boundaries(polls: DataFrame, market: Market = COTTON) -> DataFrame:
    """First poll on or after each boundary time, once per (session, contract, boundary)."""
    wide = useful_polls(polls).groupBy("session_date", "contract").agg(*_first_readings(market))
    return _reading_rows(wide, market)


def interim_windows(wide: DataFrame, market: Market = COTTON) -> DataFrame:
    """Night and day so far: a boundary not reached yet is replaced by the latest reading."""
    v_open, v_mid, v_end = (F.col(f"volume_{b}") for b in market.boundaries)
    last = F.col("last_volume")
    night = clamp(F.coalesce(v_mid, last) - v_open)
    day = F.when(v_mid.isNotNull(), clamp(F.coalesce(v_end, last) - v_mid))
    return wide.withColumn("night", F.when(v_open.isNotNull(), night)).withColumn("day", day).withColumn(
        "full", F.col("night") + F.coalesce(F.col("day"), F.lit(0.0)))


def counter_resets(readings: DataFrame, market: Market = COTTON, tolerance: float = 0.5) -> DataFrame:
    """Does a contract's counter restart at the open? Compares it with the previous close.

    Below ``tolerance`` times the previous closing reading counts as a reset.
    """
    opening, _, closing = market.boundaries
    wide = pivot_boundaries(readings, market)
    order = Window.partitionBy("contract").orderBy("session_date")
    pairs = wide.select("session_date", "contract", F.col("v_open").alias("open_volume"),
                        F.lag("v_end").over(order).alias("prev_close"))
    state = F.when(F.col("open_volume").isNull() | F.col("prev_close").isNull(), None) \
        .when(F.col("open_volume") < F.col("prev_close") * tolerance, "reset").otherwise("carried")
    return pairs.withColumn("state", state)
