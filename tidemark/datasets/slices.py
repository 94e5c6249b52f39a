"""Slices shared by the documented datasets: latest date, filters, newest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMODITIES = ("CT", "KC", "CC", "SB")


def latest(df: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the latest date, overall or per key.

    Overall, the date is a scalar subquery that reaches the scan as a filter. Per key, the
    dates (one row per key) are joined back, so rows are never ranked or shuffled by key.
    """
    if not keys:
        return df.filter(F.col(date) == df.select(F.max(date)).scalar())
    last = df.groupBy(*keys).agg(F.max(date).alias(date))
    return df.join(last, [*keys, date])


def check_choice(value: str | None, allowed: Sequence[str], what: str) -> str | None:
    if value is None:
        return None
    code = value.strip().upper()
    if code not in allowed:
        raise ValueError(f"invalid {what}: {value!r}, expected one of {', '.join(allowed)}")
    return code


def where(df: DataFrame, date: str | None = None, start: str | None = None, end: str | None = None,
          **equals) -> DataFrame:
    """Optional exact filters and an inclusive date range; None means no filter."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def newest(df: DataFrame, date: str, rows: int | None = None, *tie_breakers: str) -> DataFrame:
    """The newest rows, as a distributed top-k; without a number all rows."""
    return df if rows is None else df.orderBy(F.desc(date), *tie_breakers).limit(rows)


def weeks_or_default(weeks, default: int | None = None, most: int | None = None) -> int | None:
    """Requested number of weeks; what is no positive number means the default, None all weeks.

    ``most`` clamps large values where the caller wants it.
    """
    try:
        n = int(weeks)
    except (TypeError, ValueError):
        return default
    if n <= 0:
        return default
    return n if most is None else min(n, most)


def by_date_or_newest(df: DataFrame, date: str, exact: str | None = None, rows: int | None = None) -> DataFrame:
    """An exact date wins over the newest rows; neither gives the whole series."""
    if exact is not None:
        return df.filter(F.col(date) == F.lit(exact).cast("date"))
    return df if rows is None else newest(df, date, rows)


def counts(df: DataFrame, **conditions) -> DataFrame:
    """Row count and conditional counts of a result."""
    return df.agg(F.count("*").alias("count"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
