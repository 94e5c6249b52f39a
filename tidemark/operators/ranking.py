"""Contracts by volume, latest sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_contracts(slots: DataFrame, group: Sequence[str], value: str,
                   contract: str = "generic_code") -> DataFrame:
    """Contracts of a group by value, largest first, those without volume left out.

    A group is one session (and window) and holds at most one row per tracked slot.
    """
    order = Window.partitionBy(*group).orderBy(F.desc(value), contract)
    return slots.filter(F.col(value) > 0).withColumn("rank", F.row_number().over(order))


def without_volume(totals: DataFrame, value: str) -> DataFrame:
    """Groups whose report shows the no-volume marker."""
    return totals.filter(F.coalesce(F.col(value), F.lit(0.0)) <= 0)


def last_sessions(df: DataFrame, n: int, date: str = "session_date") -> DataFrame:
    """The n most recent distinct dates (a top-k, not a sort of everything)."""
    return df.select(date).distinct().orderBy(F.desc(date)).limit(n)
