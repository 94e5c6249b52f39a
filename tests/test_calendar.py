"""Holidays by rule against lists made by hand, and business-day shifts."""

from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import easter, falls_on_holiday, holidays, plus_business_days, trading_calendar
from tidemark.functions.sessions import is_closed, is_holiday, next_business_day
from tidemark.settings import COTTON, US_EXCHANGE, Market

RULED = Market(closed_dates=(), holiday_rules=US_EXCHANGE)
BY_HAND = {
    2024: ["01-01", "01-15", "02-19", "03-29", "05-27", "06-19", "07-04", "09-02", "11-28", "12-25"],
    2025: ["01-01", "01-20", "02-17", "04-18", "05-26", "06-19", "07-04", "09-01", "11-27", "12-25"],
    2026: ["01-01", "01-19", "02-16", "04-03", "05-25", "06-19", "07-03", "09-07", "11-26", "12-25"],
    2027: ["01-01", "01-18", "02-15", "03-26", "05-31", "06-18", "07-05", "09-06", "11-25", "12-24"],
    2028: ["01-01", "01-17", "02-21", "04-14", "05-29", "06-19", "07-04", "09-04", "11-23", "12-25"],
    2029: ["01-01", "01-15", "02-19", "03-30", "05-28", "06-19", "07-04", "09-03", "11-22", "12-25"],
    2030: ["01-01", "01-21", "02-18", "04-19", "05-27", "06-19", "07-04", "09-02", "11-28", "12-25"],
}


def test_rules_give_the_lists_made_by_hand(spark):
    years = spark.createDataFrame([(y,) for y in BY_HAND], "y int")
    got = {r.y: [d.isoformat()[5:] for d in r.h] for r in years.select("y", holidays(F.col("y"), RULED).alias("h")).collect()}
    assert got == BY_HAND
    assert tuple(f"2026-{d}" for d in BY_HAND[2026]) == COTTON.closed_dates


def test_easter(spark):
    """Dates as published; the earliest, the latest and the two exceptions of the epact."""
    known = {1818: "03-22", 1886: "04-25", 1943: "04-25", 1954: "04-18", 1981: "04-19", 2000: "04-23", 2008: "03-23", 2016: "03-27", 2019: "04-21",
             2038: "04-25", 2049: "04-18", 2076: "04-19", 2285: "03-22"}
    got = spark.createDataFrame([(y,) for y in known], "y int").select("y", easter(F.col("y")).alias("d")).collect()
    assert {r.y: r.d.isoformat()[5:] for r in got} == known


def test_every_day_of_a_century(spark):
    days = spark.sql("SELECT explode(sequence(date'1990-01-01', date'2089-12-31')) AS d")
    listed = days.select(F.year("d").alias("y")).distinct().select(F.explode(holidays(F.col("y"), RULED)).alias("d"))
    by_day = days.filter(falls_on_holiday(F.col("d"), RULED))
    assert sorted(r.d for r in by_day.collect()) == sorted(r.d for r in listed.collect())


def test_listed_years_come_before_the_rules(spark):
    market = replace(COTTON, holiday_rules=US_EXCHANGE, closed_dates=("2027-03-01",))
    days = spark.createDataFrame([("2027-03-01",), ("2027-12-24",), ("2028-12-25",), ("2028-03-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    assert [r.h for r in days.select(is_holiday(F.col("d"), market).alias("h")).collect()] == [True, False, True, False]


def is_open(d):
    return d.weekday() < 5 and d.isoformat()[5:] not in BY_HAND.get(d.year, [])


@pytest.fixture(scope="module")
def calendar(spark):
    return trading_calendar(spark, 2024, 2030, RULED)


def test_ordinals_count_open_days(calendar):
    rows = sorted(calendar.collect())
    assert rows[0].date == date(2024, 1, 1) and rows[-1].date == date(2030, 12, 31) and len(rows) == 2557
    count = 0
    for r in rows:
        count += is_open(r.date)
        assert r.is_open == is_open(r.date) and r.ordinal == count


def test_shifts(spark, calendar):
    days = [date(2024, 3, 27) + timedelta(days=k) for k in range(0, 2400, 3)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,), (date(2040, 1, 1),)], "d date")
    got = {r.d: (r.one, r.two, r.back, r.expr) for r in plus_business_days(df, "d", {"one": 1, "two": 2, "back": -1}, calendar).withColumn(
        "expr", next_business_day(F.col("d"), RULED)).collect()}

    def step(d, n):
        while n:
            d += timedelta(days=1 if n > 0 else -1)
            if is_open(d):
                n -= 1 if n > 0 else -1
        return d

    for d in days:
        before = d if is_open(d) else step(d, -1)
        assert got[d][:2] == (step(d, 1), step(d, 2)) and got[d][3] == step(d, 1)
        assert got[d][2] == step(before, -1)
    assert got[None][:3] == (None, None, None) and got[date(2040, 1, 1)][:3] == (None, None, None)


def test_closed_sessions_of_a_year_that_is_not_listed(spark):
    market = replace(COTTON, holiday_rules=US_EXCHANGE)
    days = spark.sql("SELECT explode(sequence(date'2027-01-01', date'2027-12-31')) AS d").filter(~is_closed(F.col("d"), market))
    assert days.count() == 261 - len(BY_HAND[2027])
