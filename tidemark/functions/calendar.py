"""Exchange holidays of any year from rules, and a calendar table with business-day ordinals.

A rule names a holiday of a year: a fixed date (moved to Monday from a Sunday, to Friday from a Saturday where the rule
says so), the n-th or last weekday of a month, or days from Easter Sunday. Everything is a column expression over a year.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.settings import HolidayRule, Market


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday in the Gregorian calendar, from the age of the moon and the weekday of its full moon."""
    golden, century = year % 19, _div(year, 100)
    in_century = year % 100
    moon = (golden * 19 + century - _div(century, 4) - _div(century - _div(century + 8, 25) + 1, 3) + 15) % 30
    to_sunday = (32 + century % 4 * 2 + _div(in_century, 4) * 2 - moon - in_century % 4) % 7
    late = _div(golden + moon * 11 + to_sunday * 22, 451)
    days = moon + to_sunday - late * 7 + 114
    return F.make_date(year, _div(days, 31), days % 31 + 1)


def _date_of(rule: HolidayRule, year: Column) -> Column:
    if rule.kind == "easter":
        day = F.date_add(easter(year), rule.day)
    elif rule.kind == "weekday":
        first = F.make_date(year, F.lit(rule.month), F.lit(1))
        if rule.nth > 0:
            day = F.date_add(first, (rule.day - F.weekday(first) + 7) % 7 + 7 * (rule.nth - 1))
        else:
            last = F.last_day(first)
            day = F.date_sub(last, (F.weekday(last) - rule.day + 7) % 7)
    else:
        fixed = F.make_date(year, F.lit(rule.month), F.lit(rule.day))
        moved = F.when(F.weekday(fixed) == 6, F.date_add(fixed, 1))
        if rule.saturday:
            moved = moved.when(F.weekday(fixed) == 5, F.date_sub(fixed, 1))
        day = moved.otherwise(fixed)
    return F.when(year >= rule.since, day)


def holidays(year: Column, market: Market) -> Column:
    """array<date>: the holidays of a year, listed ones where the market lists that year, else by its rules."""
    listed = sorted({int(d[:4]) for d in market.closed_dates})
    by_rule = F.array_compact(F.array(*[_date_of(r, year) for r in market.holiday_rules])) if market.holiday_rules else F.array().cast("array<date>")
    if not listed:
        return by_rule
    given = F.expr(f"array({', '.join(f"date'{d}'" for d in market.closed_dates)})")
    return F.when(year.isin(listed), F.filter(given, lambda d: F.year(d) == year)).otherwise(by_rule)


def falls_on_holiday(day: Column, market: Market) -> Column:
    """Is ``day`` a holiday? Per rule the month is compared first, so most rows compute no holiday at all."""
    months = {"easter": lambda r: (3, 4), "weekday": lambda r: (r.month,), "fixed": lambda r: tuple({(r.month - 2) % 12 + 1, r.month, r.month % 12 + 1})}
    year = F.year(day)
    by_rule = reduce(or_, [F.month(day).isin(*months[r.kind](r)) & F.coalesce(day == _date_of(r, year), F.lit(False)) for r in market.holiday_rules])
    listed = sorted({int(d[:4]) for d in market.closed_dates})
    if not listed:
        return by_rule
    given = day.isin(*[date.fromisoformat(d) for d in market.closed_dates])
    return F.when(year.isin(listed), given).otherwise(by_rule)


def trading_calendar(spark: SparkSession, first_year: int, last_year: int, market: Market) -> DataFrame:
    """(date, is_open, ordinal) for every day of the years; the ordinal counts the open days up to it, from the first year.

    With it a shift by business days is an addition of ordinals. The days of a year are one window, the years' totals
    (a number each) are added up on the driver.
    """
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    days = years.withColumn("closed", holidays(F.col("year"), market)).select("year", "closed", F.explode(F.sequence(
        F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("date"))
    opened = days.select("year", "date", ((F.weekday("date") < 5) & ~F.array_contains("closed", F.col("date"))).alias("is_open"))
    before, total = {}, 0
    for r in sorted(opened.groupBy("year").agg(F.count_if("is_open").alias("n")).collect()):
        before[r.year], total = total, total + r.n
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("year")]
    within = F.sum(F.col("is_open").cast("int")).over(Window.partitionBy("year").orderBy("date"))
    return opened.select("date", "is_open", (within + offset).cast("int").alias("ordinal"))


def plus_business_days(df: DataFrame, date: str, shifts: dict[str, int], calendar: DataFrame) -> DataFrame:
    """``df`` with columns of ``date`` moved by business days: name -> number (1 is the first open day after it).

    From a closed day the count begins at the open day before it. A day or target outside the calendar gives null.
    """
    places = calendar.select(F.col("date").alias("_from"), F.col("ordinal").alias("_ordinal"))
    targets = calendar.filter("is_open").select("ordinal", F.col("date").alias("_to"))
    out = df.join(places, F.col(date) == F.col("_from"), "left").drop("_from")
    for name, n in shifts.items():
        to = targets.select(F.col("ordinal").alias("_at"), F.col("_to").alias(name))
        out = out.join(to, F.col("_ordinal") + n == F.col("_at"), "left").drop("_at")
    return out.drop("_ordinal")
