"""Parsed options flow and gamma exposure of an options chain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.datasets.slices import where

# Dollars per cent of one contract; strikes below which a surface is thin.
DOLLARS_PER_CENT = 500
MIN_STRIKES = 20


def parsed_flow(flow: DataFrame, date: str | None = None, start: str | None = None, end: str | None = None,
                grammar_valid: bool | None = None, min_volume: int = 1, structure: str | None = None,
                month: str | None = None) -> DataFrame:
    """Parsed trades with any combination of filters."""
    out = where(flow, "snapshot_date", date or start, date or end, grammar_valid=grammar_valid,
                parsed_structure=structure, parsed_month=month)
    return out.filter(F.col("volume") >= min_volume)


def gamma_exposure(chain: DataFrame) -> DataFrame:
    """Per trade date: net exposure (calls positive), walls and number of strikes.

    A wall is the strike with the largest gamma of its side, the lowest one on ties.
    """
    weight = F.col("gamma") * F.col("open_int")
    per_strike = chain.groupBy("trade_date", "strike").agg(
        F.sum(F.when(F.col("put_call") == "C", weight)).alias("call_gamma"),
        F.sum(F.when(F.col("put_call") == "P", weight)).alias("put_gamma"))

    def wall(side: str) -> Column:
        return F.max_by("strike", F.when(F.col(side).isNotNull(), F.struct(F.col(side), -F.col("strike"))))

    net = F.sum(F.coalesce("call_gamma", F.lit(0.0)) - F.coalesce("put_gamma", F.lit(0.0)))
    out = per_strike.groupBy("trade_date").agg(
        net.alias("net_gex_contracts"), wall("call_gamma").alias("call_wall"), wall("put_gamma").alias("put_wall"),
        F.count("*").alias("n_strikes"))
    return out.withColumn("net_gex_dollars", F.col("net_gex_contracts") * DOLLARS_PER_CENT) \
        .withColumn("is_thin", F.col("n_strikes") < MIN_STRIKES)


def black_gamma(spot: Column, strike: Column, vol: Column, years: Column) -> Column:
    """Gamma of an option on a future (Black 1976, no discounting) as a column expression."""
    spread = vol * F.sqrt(years)
    d1 = (F.ln(spot / strike) + F.lit(0.5) * vol * vol * years) / spread
    density = F.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
    return density / (spot * spread)


def terrain(chain: DataFrame, steps: int = 45, width: float = 0.45) -> DataFrame:
    """Net gamma on a grid of hypothetical spots around the forward of each trade date.

    The grid runs from -width to +width of the forward in 2 * steps equal steps. Options are
    first summed per (date, strike, vol, expiry), so the grid multiplies the surface, not
    the chain; the sum over the surface is partially aggregated before it is shuffled.
    """
    signed = F.when(F.col("put_call") == "C", F.col("open_int")).otherwise(-F.col("open_int"))
    surface = chain.groupBy("trade_date", "forward", "strike", "vol", "years").agg(F.sum(signed).alias("lots"))
    k = F.explode(F.sequence(F.lit(-steps), F.lit(steps))).alias("k")
    grid = surface.select("*", k)
    spot = F.col("forward") * (1 + F.col("k") * (width / steps))
    gamma = black_gamma(spot, F.col("strike"), F.col("vol"), F.col("years"))
    return grid.groupBy("trade_date", "forward", "k").agg(F.sum(gamma * F.col("lots")).alias("net_gex")).withColumn(
        "spot", F.col("forward") * (1 + F.col("k") * (width / steps)))


def balance_points(grid: DataFrame) -> DataFrame:
    """Spot at which net gamma changes sign, interpolated: the crossing nearest the forward.

    A date holds one row per grid step. A date without a crossing has nulls and no crossings.
    """
    order = Window.partitionBy("trade_date").orderBy("k")
    pairs = grid.select("trade_date", "forward", "spot", "net_gex", F.lag("spot").over(order).alias("s0"),
                        F.lag("net_gex").over(order).alias("g0"))
    crosses = (F.signum("g0") * F.signum("net_gex") < 0) | (F.col("net_gex") == 0)
    at = F.when(F.col("net_gex") == 0, F.col("spot")).otherwise(
        F.col("s0") + (F.col("spot") - F.col("s0")) * F.col("g0") / (F.col("g0") - F.col("net_gex")))
    crossing = pairs.withColumn("balance", F.when(crosses, at))
    distance = F.abs(F.col("balance") - F.col("forward"))
    upward = F.when((F.col("g0") < 0) & (F.col("net_gex") > 0), distance)  # null where there is no crossing
    return crossing.groupBy("trade_date").agg(
        F.min_by("balance", distance).alias("balance"), F.min_by("balance", upward).alias("gamma_flip"),
        F.count("balance").alias("n_crossings"))


def speed_peak(grid: DataFrame) -> DataFrame:
    """Distance from the forward to the steepest step of the terrain, the lower one on ties."""
    order = Window.partitionBy("trade_date").orderBy("k")
    steps = grid.select("trade_date", "forward", "k", ((F.col("spot") + F.lag("spot").over(order)) / 2).alias("middle"),
                        F.abs(F.col("net_gex") - F.lag("net_gex").over(order)).alias("step"))
    return steps.filter(F.col("step").isNotNull()).groupBy("trade_date").agg(
        F.max_by(F.col("middle") - F.col("forward"), F.struct(F.round("step", 9), -F.col("k"))).alias("speed_peak_offset"))


def vol_sensitivity(chain: DataFrame, point: float = 0.01) -> DataFrame:
    """Change of net gamma at the forward for one more point of volatility."""
    signed = F.when(F.col("put_call") == "C", F.col("open_int")).otherwise(-F.col("open_int"))
    surface = chain.groupBy("trade_date", "forward", "strike", "vol", "years").agg(F.sum(signed).alias("lots"))

    def net(vol: Column) -> Column:
        return F.sum(black_gamma(F.col("forward"), F.col("strike"), vol, F.col("years")) * F.col("lots"))

    return surface.groupBy("trade_date").agg(
        (net(F.col("vol") + point) - net(F.col("vol"))).alias("vol_sensitivity"))


def convexity(chain: DataFrame, atm: DataFrame) -> DataFrame:
    """Net gamma at the forward and one and two sigma away from it, per trade date.

    ``atm`` is (trade_date, sigma): at-the-money vol x forward x sqrt(years).
    """
    signed = F.when(F.col("put_call") == "C", F.col("open_int")).otherwise(-F.col("open_int"))
    surface = chain.groupBy("trade_date", "forward", "strike", "vol", "years").agg(F.sum(signed).alias("lots"))
    rows = surface.join(atm, "trade_date")

    def net(shift: float) -> Column:
        spot = F.col("forward") + F.col("sigma") * shift
        return F.sum(black_gamma(spot, F.col("strike"), F.col("vol"), F.col("years")) * F.col("lots"))

    out = rows.groupBy("trade_date").agg(
        net(0.0).alias("atm_gamma"), ((net(1.0) + net(-1.0)) / 2).alias("g_1sigma"),
        ((net(2.0) + net(-2.0)) / 2).alias("g_2sigma"), F.count_distinct("strike").alias("n_strikes"))
    return out.withColumn("sigma_1_2_spread", F.col("g_1sigma") - F.col("g_2sigma")) \
        .withColumn("is_thin", F.col("n_strikes") < MIN_STRIKES)
