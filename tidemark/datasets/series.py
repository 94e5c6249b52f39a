"""Statistics of daily and weekly series. Every window holds one named series of dated rows.

With ``block_rows`` a window holds a block of that many rows of a series, with the same results (``operators.blocks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import ratio
from tidemark.operators.blocks import joined, percent_rank, sliding


def _rows(keys: Sequence[str], date: str, back: int):
    return Window.partitionBy(*keys).orderBy(date).rowsBetween(-back, 0)


def rolling_zscore(value: str, keys: Sequence[str], date: str, n: int) -> Column:
    frame = _rows(keys, date, n - 1)
    return ratio(F.col(value) - F.avg(value).over(frame), F.stddev(value).over(frame))


def with_log_return(df: DataFrame, value: str, keys: Sequence[str], date: str) -> DataFrame:
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(date))
    return df.withColumn("log_return", F.ln(ratio(F.col(value), prev)))


def realised_vol(keys: Sequence[str], date: str, n: int, per_year: int = 252) -> Column:
    """Annualised standard deviation, in percent, of the last n log returns."""
    return F.stddev("log_return").over(_rows(keys, date, n - 1)) * F.sqrt(F.lit(per_year)) * 100


def vol_signals(df: DataFrame, value: str, keys: Sequence[str], date: str, year: int = 252, block_rows: int | None = None) -> DataFrame:
    """30- and 60-day realised volatility and the one-year z-score of a price series."""
    def windows(rows: DataFrame, by: list[str], more: list[str]) -> DataFrame:
        out = with_log_return(rows, value, by, date)
        return out.select(
            *df.columns, *more, realised_vol(by, date, 30).alias("hv30"), realised_vol(by, date, 60).alias("hv60"),
            rolling_zscore(value, by, date, year).alias("zscore_1yr"))

    # the first return of a frame looks one row further back
    return sliding(df, keys, date, max(60, year - 1), windows, block_rows)


def extremes(df: DataFrame, value: str, keys: Sequence[str], date: str, high: float = 90.0, low: float = 10.0,
             very_high: float = 95.0, very_low: float = 5.0, block_rows: int | None = None) -> DataFrame:
    """Percentile rank in the whole history, z-score, 20-day volatility and an extreme flag.

    The cut-offs are parameters. Mean and deviation of a history are partially aggregated and joined back.
    """
    def windows(rows: DataFrame, by: list[str], more: list[str]) -> DataFrame:
        return with_log_return(rows, value, by, date).select(*df.columns, *more, realised_vol(by, date, 20).alias("vol_20d"))

    swung = sliding(df, keys, date, 20, windows, block_rows)
    ranked = percent_rank(swung, keys, value, "rank", block_rows).withColumn("rank", F.col("rank") * 100)
    if block_rows is None:
        whole = Window.partitionBy(*keys)
        out = ranked.withColumn("zscore", ratio(F.col(value) - F.avg(value).over(whole), F.stddev(value).over(whole)))
    else:
        sums = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev(value).alias("_spread"))
        out = joined(ranked, sums, keys).withColumn("zscore", ratio(F.col(value) - F.col("_mean"), F.col("_spread"))).drop("_mean", "_spread")
    flag = (F.when(F.col("rank") >= very_high, "!! HI").when(F.col("rank") <= very_low, "!! LO")
            .when(F.col("rank") >= high, "HI").when(F.col("rank") <= low, "LO"))
    return out.withColumn("flag", flag).select(*df.columns, "rank", "zscore", "vol_20d", "flag")


def moving_average(df: DataFrame, value: str, keys: Sequence[str], date: str, n: int = 13, lag: int = 13,
                   block_rows: int | None = None) -> DataFrame:
    """n-row moving average and its copy ``lag`` rows earlier (the lag length is a parameter)."""
    def windows(rows: DataFrame, by: list[str], more: list[str]) -> DataFrame:
        out = rows.withColumn(f"sma_{value}", F.avg(value).over(_rows(by, date, n - 1)))
        order = Window.partitionBy(*by).orderBy(date)
        return out.select(*df.columns, *more, f"sma_{value}", F.lag(f"sma_{value}", lag).over(order).alias(f"lagged_sma_{value}"))

    return sliding(df, keys, date, n - 1 + lag, windows, block_rows)


def running_total(value: str, keys: Sequence[str], date: str) -> Column:
    return F.sum(value).over(
        Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0))


def marketing_year(date: Column, first_month: int = 8) -> Column:
    """The year a marketing year starts in."""
    return F.year(date) - F.when(F.month(date) < first_month, 1).otherwise(0)


def two_source_totals(df: DataFrame, date: str, a: str, b: str, first_month: int = 8) -> DataFrame:
    """Marketing- and calendar-year running totals of two sources and their differences."""
    years = df.withColumn("my", marketing_year(F.col(date), first_month)).withColumn("cy", F.year(date))
    out = years.select(
        *years.columns,
        *[running_total(c, [y], date).alias(f"{c}_{y}_cum") for c in (a, b) for y in ("my", "cy")])
    return out.withColumn("diff", F.col(b) - F.col(a)).withColumn("my_diff", F.col(f"{b}_my_cum") - F.col(f"{a}_my_cum"))


def progress(df: DataFrame, state: str, year: str, week: str, value: str) -> DataFrame:
    """Value against the same week of last year, of 3- and 5-year means, and the week before.

    Means use the years present among the previous 3 or 5 calendar years.
    """
    same_week = Window.partitionBy(state, week).orderBy(year)
    within = Window.partitionBy(state, year).orderBy(week)

    def past(n: int) -> Column:
        return F.avg(value).over(same_week.rangeBetween(-n, -1))

    out = df.withColumn("prev_yr", F.max(value).over(same_week.rangeBetween(-1, -1))) \
        .withColumn("avg_3yr", past(3)).withColumn("avg_5yr", past(5)) \
        .withColumn("wow_chg", F.col(value) - F.lag(value).over(within))
    return out.withColumn("vs_prev", F.col(value) - F.col("prev_yr")) \
        .withColumn("vs_3yr", F.col(value) - F.col("avg_3yr")).withColumn("vs_5yr", F.col(value) - F.col("avg_5yr"))


def text_date(c: Column, pattern: str = "MM/dd/yyyy") -> Column:
    return F.try_to_date(c, pattern)


def history_and_forecast(df: DataFrame, date: str, flag: str, start: str | None = None) -> DataFrame:
    """Observed and forecast rows with a ``part`` column; the start filter spares the forecast."""
    is_forecast = F.col(flag) == 1
    keep = is_forecast
    keep = keep | (F.lit(True) if start is None else F.col(date) >= F.lit(start).cast("date"))
    return df.filter(keep).withColumn("part", F.when(is_forecast, "forecast").otherwise("history"))
