"""Certified stocks: headline figures, quality matrix, bucket distributions, balance sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(stocks: DataFrame) -> DataFrame:
    return stocks.groupBy("date").agg(F.sum("bales").alias("total"))


def headline(totals: DataFrame) -> DataFrame:
    """Latest total, one-day change, 52-week range, all-time high and the year-ago figure.

    One aggregate over the daily totals relative to the latest date (a scalar subquery).
    """
    as_of = totals.select(F.max("date")).scalar()
    date, total = F.col("date"), F.col("total")
    # order-independent: per-date maxima, earliest date on ties
    t = totals.withColumn("as_of", as_of)
    year = date > F.date_sub("as_of", 364)
    before = F.when(date < F.col("as_of"), date)
    year_ago = F.when(date <= F.add_months("as_of", -12), date)
    out = t.agg(
        F.max("as_of").alias("as_of"), F.max_by(total, date).alias("total"),
        F.max_by(total, before).alias("prev"),
        F.max(F.when(year, total)).alias("hi_52w"), F.min(F.when(year, total)).alias("lo_52w"),
        F.max(total).alias("hi_all"),
        F.max_by(total, year_ago).alias("ya_total"), F.max(year_ago).alias("ya_date"),
        (-F.max(F.struct(total, (-F.unix_date(date)).alias("neg_day")))["neg_day"]).alias("hi_day"))
    return out.select("as_of", "total", (F.col("total") - F.col("prev")).alias("chg_1d"), "hi_52w", "lo_52w",
                      "hi_all", F.date_from_unix_date("hi_day").alias("hi_all_date"), "ya_total", "ya_date")


def by_location(stocks: DataFrame) -> DataFrame:
    """Latest figure and change against the location's previous date."""
    per_day = stocks.groupBy("location", "date").agg(F.sum("bales").alias("bales"))
    order = Window.partitionBy("location").orderBy("date")
    out = per_day.withColumn("chg", F.col("bales") - F.lag("bales").over(order))
    # the newest row per location
    return out.groupBy("location").agg(F.max("date").alias("date"), F.max_by("bales", "date").alias("bales"),
                                       F.max_by("chg", "date").alias("chg"))


def rolling_range(totals: DataFrame, keys: Sequence[str], days: int = 364) -> DataFrame:
    """52-week high and low of every series as of every date, over calendar days."""
    frame = Window.partitionBy(*keys).orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    return totals.select(*keys, "date", "total", F.max("total").over(frame).alias("hi"), F.min("total").over(frame).alias("lo"))


def buckets(value: Column, labels: dict[str, Column]) -> list[Column]:
    return [F.sum(F.when(cond, value).otherwise(0)).alias(name) for name, cond in labels.items()]


def matrix(df: DataFrame, point: str, rows: Sequence[str], value: str, labels: dict[str, Column]) -> DataFrame:
    """Bucketed sums per row key, per point and nationally, with the grand totals.

    ``level`` tells the grain: 'cell' (rows of a point), 'point' (its total), 'national' (rows
    over all points) and 'grand'. The cells are summed first, so the grouping sets multiply
    the few cells and not the lots.
    """
    cells = df.groupBy(point, *rows).agg(*buckets(F.col(value), labels), F.sum(value).alias("total"))
    cols = [F.col(c) for c in rows]
    grouped = cells.groupingSets([[F.col(point), *cols], [F.col(point)], cols, []], F.col(point), *cols)
    key = F.grouping(point) * 2 + F.grouping(rows[0])
    out = grouped.agg(*[F.sum(c).alias(c) for c in (*labels, "total")], key.alias("_g"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("cell", "point", "national", "grand")]),
                         (F.col("_g") + 1).cast("int"))
    return out.withColumn("level", level).drop("_g")


def with_empty_points(points: DataFrame, totals: DataFrame, point: str, value: str) -> DataFrame:
    """Totals of every known point, 0 where there is no stock."""
    return points.join(totals, point, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def distribution(df: DataFrame, point: str, bucket: str, value: str, names: Sequence) -> DataFrame:
    """Buckets as columns by delivery point, with a national row, what no bucket names and a total.

    Points are summed first; the rollup then sees one row per point.
    """
    named = F.coalesce(F.col(bucket).isin(list(names)), F.lit(False))
    sums = buckets(F.col(value), {str(n): F.col(bucket) == F.lit(n) for n in names} | {"other": ~named})
    points = df.groupBy(point).agg(*sums, F.sum(value).alias("total"))
    out = points.rollup(point).agg(*[F.sum(f"`{c}`").alias(c) for c in [*map(str, names), "other", "total"]])
    return out.withColumn(point, F.coalesce(point, F.lit("national")))


def top_list(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sums per key with their rank, largest first."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias(value))
    return sums.orderBy(F.desc(value), *keys)


def stock_summary(sums: DataFrame, value: str) -> DataFrame:
    return sums.agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.count_if(F.col(value) > 0).alias("n_with_stock"))


def balance_identities(wide: DataFrame) -> DataFrame:
    """Supply and total use of a balance sheet, and what the identity leaves unaccounted."""
    out = wide.withColumn("Supply", F.col("BegStk") + F.col("Prod") + F.col("Imports")) \
        .withColumn("TotalUse", F.col("DomUse") + F.col("Exports"))
    return out.withColumn("Unacct", F.col("Supply") - F.col("TotalUse") - F.col("EndStk"))


def years_to_rows(wide: DataFrame, keys: Sequence[str], years: Sequence[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(list(keys), list(years), name, value)


def rows_to_years(long: DataFrame, keys: Sequence[str], years: Sequence, name: str, value: str) -> DataFrame:
    """One column per listed year, null without rows, and ``other`` for the years not listed."""
    def total(of: Column, column: str) -> Column:
        return F.sum(F.when(of, F.col(value))).alias(column)

    listed = F.coalesce(F.col(name).isin(list(years)), F.lit(False))
    return long.groupBy(*keys).agg(*[total(F.col(name) == F.lit(y), str(y)) for y in years], total(~listed, "other"))
