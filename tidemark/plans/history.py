"""Queries over the permanent histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.symbology import resolve_generic


def between(df: DataFrame, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def session_history(history: DataFrame, start: str | None = None, end: str | None = None,
                    window: str = "both", fields: Sequence[str] | None = None) -> DataFrame:
    """Session rows of a date range with the columns of one window or both."""
    hidden = {"overnight": "day_", "day": "overnight_"}.get(window)
    columns = [c for c in history.columns if hidden is None or not c.startswith(hidden)]
    if fields is not None:
        columns = [c for c in columns if c in fields]
    return between(history, "date", start, end).select(*columns)


def range_summary(rows: DataFrame, date: str) -> DataFrame:
    """Effective range and row count of a result."""
    return rows.agg(F.min(date).alias("from"), F.max(date).alias("to"), F.count("*").alias("count"))


def contract_history(rows: DataFrame, start: str | None = None, end: str | None = None,
                     generic: str | None = None, month_code: str | None = None,
                     window: str = "both") -> DataFrame:
    out = between(rows, "session_date", start, end)
    if generic is not None:
        out = out.filter(F.col("generic_code") == generic)
    if month_code is not None:
        out = out.filter(F.col("month_code") == month_code)
    if window != "both":
        out = out.filter(F.col("window") == window)
    return out


def generic_history(bars: DataFrame, generic: str | None = None, start: str | None = None,
                    end: str | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """Daily bars of a generic with the contract it stood for on each date."""
    out = between(bars, "session_date", start, end)
    if generic is not None:
        out = out.filter(F.col("generic") == generic)
    info = resolve_generic(F.col("generic"), F.col("session_date"))
    out = out.withColumn("ice_code", info["ice_code"]).withColumn("delivery_year", info["delivery_year"])
    return out.select(*[c for c in out.columns if fields is None or c in fields])


def month_over_years(contracts: DataFrame, month_code: str, value: str = "full") -> DataFrame:
    """One delivery month across years: volume per position and delivery year."""
    return contracts.filter(F.col("month_code") == month_code).groupBy("position", "delivery_year").agg(
        F.count("*").alias("n_sessions"), F.sum(value).alias("volume"), F.max(value).alias("peak"),
        F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"))


def with_open_interest(volumes: DataFrame, interest: DataFrame) -> DataFrame:
    """Contract volumes next to open interest and settlement of the same date and slot."""
    oi = interest.select(F.col("date").alias("session_date"), F.col("contract").alias("generic_code"),
                         "open_int", "settle")
    return volumes.join(oi, ["session_date", "generic_code"])
