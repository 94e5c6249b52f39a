"""Comparison of a session with its trailing sessions.

Input is at session grain: one row per key and date, so a window partition holds one series
(a few thousand rows for decades of sessions), whatever the size of the tape behind it. For series of
finer grain ``block_rows`` cuts them into blocks of that many rows (``blocks``), with the same results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.formats import have_note
from tidemark.functions.parsing import ratio
from tidemark.operators.blocks import last_before, sliding
from tidemark.settings import COTTON, Market


def volume_flag(rvol: Column, market: Market = COTTON) -> Column:
    return F.when(rvol >= market.high, "HIGH").when(rvol <= market.low, "LOW")


def _tier_array(keys: Sequence[str], date: str, value: str, market: Market, inclusive: bool = False) -> Column:
    """array(struct(tier, avg, n)): mean and count of up to ``tier`` earlier rows of a series,
    counting the row itself when ``inclusive``."""
    by = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} " if keys else ""

    def entry(tier: int) -> str:
        first, last = (f"{tier - 1} PRECEDING", "CURRENT ROW") if inclusive else (f"{tier} PRECEDING", "1 PRECEDING")
        over = f"OVER ({by}ORDER BY `{date}` ROWS BETWEEN {first} AND {last})"
        return f"struct({tier} AS tier, avg(`{value}`) {over} AS avg, count(`{value}`) {over} AS n)"

    return F.expr(f"array({', '.join(entry(t) for t in market.tiers)})")


def _finish(df: DataFrame, keep: Sequence[str], value: str, mode: str, market: Market) -> DataFrame:
    """Explode the tiers and derive ratio, note and flag.

    degrade: a short lookback still yields an average, with a note.
    strict:  fewer sessions than the tier yield no average and no ratio.
    """
    tier, n = F.col("_tier.tier"), F.col("_tier.n")
    enough = n >= tier
    known = F.col(value).isNotNull() & (enough if mode == "strict" else F.lit(True))
    avg = F.when(known, F.col("_tier.avg"))
    rvol = ratio(F.col(value), avg)
    note = F.when(~enough | F.col(value).isNull(), have_note(n, tier))
    return df.select(*keep, value, "prev", F.explode("tiers").alias("_tier")).select(
        *keep, value, tier.alias("tier"), avg.alias("avg"), rvol.alias("rvol"), n.alias("n"),
        enough.alias("available"), note.alias("note"), volume_flag(rvol, market).alias("flag"), "prev",
    )


def trailing(df: DataFrame, keys: Sequence[str], date: str, value: str, *,
             mode: str = "degrade", market: Market = COTTON, block_rows: int | None = None) -> DataFrame:
    """Each row against the mean of up to ``tier`` earlier rows of its own series.

    Rows without a value are skipped, not counted. All tiers share one window specification:
    one exchange, one sort.
    """
    def windows(series: DataFrame, by: list[str], more: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(date)
        return series.select(*keys, date, value, *more, F.lag(value, 1).over(order).alias("prev"),
                             _tier_array(by, date, value, market).alias("tiers"))

    rows = sliding(df.filter(F.col(value).isNotNull()), keys, date, max(market.tiers), windows, block_rows)
    return _finish(rows, [*keys, date], value, mode, market)


def trailing_against(current: DataFrame, prior: DataFrame, keys: Sequence[str], date: str,
                     value: str, *, mode: str = "degrade", market: Market = COTTON, block_rows: int | None = None) -> DataFrame:
    """Rows of ``current`` against earlier rows of another series ``prior`` of the same keys.

    The prior series is averaged once per its own row (that row included); each current row
    then takes over the latest prior row strictly before its date, found by one ordered pass
    over the union. No inequality join.
    """
    def windows(series: DataFrame, by: list[str], more: list[str]) -> DataFrame:
        return series.select(*keys, date, *more, F.lit(1).alias("_prior"), F.col(value).alias("_last"),
                             _tier_array(by, date, value, market, inclusive=True).alias("_stats"))

    stats = sliding(prior.filter(F.col(value).isNotNull()), keys, date, max(market.tiers), windows, block_rows)
    both = current.select(*keys, date, F.lit(0).alias("_prior"), value).unionByName(
        stats, allowMissingColumns=True)
    empty = F.expr("array(" + ", ".join(
        f"struct({t} AS tier, CAST(NULL AS DOUBLE) AS avg, 0L AS n)" for t in market.tiers) + ")")
    # current sorts before prior on the same date, so only strictly earlier rows are seen
    rows = last_before(both, keys, [date, "_prior"], {"prev": "_last", "tiers": "_stats"}, block_rows) \
        .filter(F.col("_prior") == 0).select(*keys, date, value, "prev", F.coalesce("tiers", empty).alias("tiers"))
    return _finish(rows, [*keys, date], value, mode, market)


def change_percent(value: Column, prev: Column) -> Column:
    return (ratio(value, prev) - 1) * 100


def direction(value: Column, prev: Column) -> Column:
    """UP from 0 % on, also where the previous value is 0; null without a previous value."""
    up = F.coalesce(change_percent(value, prev), F.lit(0.0)) >= 0
    return F.when(prev.isNotNull(), F.when(up, "UP").otherwise("DOWN"))


def previous_session(df: DataFrame, keys: Sequence[str], date: str, value: str, block_rows: int | None = None) -> DataFrame:
    """Value of the previous session that has one, percent change and direction."""
    def windows(series: DataFrame, by: list[str], more: list[str]) -> DataFrame:
        return series.select(*keys, date, value, *more, F.lag(value, 1).over(Window.partitionBy(*by).orderBy(date)).alias("prev"))

    out = sliding(df.filter(F.col(value).isNotNull()), keys, date, 1, windows, block_rows)
    change = change_percent(F.col(value), F.col("prev"))
    return out.withColumn("change_pct", change).withColumn("direction", direction(F.col(value), F.col("prev")))


def prior_values(df: DataFrame, keys: Sequence[str], date: str, value: str, limit: int, block_rows: int | None = None) -> DataFrame:
    """The last ``limit`` earlier values per row, newest first; blanks skipped."""
    def windows(series: DataFrame, by: list[str], more: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(date).rowsBetween(-limit, -1)
        return series.select(*keys, date, *more, F.reverse(F.collect_list(value).over(order)).alias("priors"))

    return sliding(df.filter(F.col(value).isNotNull()), keys, date, limit, windows, block_rows)


def as_map(tiers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long tier rows (a handful per key) to one map per key: tier text -> struct."""
    fields = F.struct(*[F.col(c) for c in ("avg", "rvol", "n", "note", "flag", "available")])
    entry = F.struct(F.col("tier").cast("string").alias("key"), fields.alias("value"))
    return tiers.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: (
            F.when(a["key"].cast("int") < b["key"].cast("int"), -1).otherwise(1)))).alias("rvol"))
