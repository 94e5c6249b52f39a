"""Coverage of bars, presence of boundary readings, reconciliation of two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import clean_code, ratio
from tidemark.functions.sessions import is_closed, is_due
from tidemark.functions.symbology import generic_of_exchange
from tidemark.settings import COTTON, Market


def coverage(bars: DataFrame) -> DataFrame:
    """First and last date and number of trading days."""
    return bars.agg(F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"),
                    F.count_distinct("session_date").alias("n_dates"))


def nonzero_days(bars: DataFrame) -> DataFrame:
    """Days with volume per generic."""
    return bars.groupBy("generic").agg(
        F.count_if(F.coalesce(F.col("volume"), F.lit(0.0)) != 0).alias("n_days")
    ).filter(F.col("n_days") > 0)


def boundary_presence(readings: DataFrame, market: Market = COTTON) -> DataFrame:
    """Per (session, boundary): was any tracked contract captured? Exchange codes only."""
    code = clean_code(F.col("contract"))
    tracked = generic_of_exchange(code, F.col("session_date"), market).isNotNull()
    label = F.trim("boundary")
    return readings.groupBy("session_date", label.alias("boundary")).agg(
        F.bool_or(F.coalesce(tracked, F.lit(False))).alias("present"))


def capture_check(calendar: DataFrame, readings: DataFrame, as_of, market: Market = COTTON,
                  force_all: bool = False, files: DataFrame | None = None) -> DataFrame:
    """Status per calendar date: closed / not due / file missing / boundary missing / OK.

    ``as_of`` is a timestamp expression. ``files`` lists the sessions that have a file; a file
    without rows is there, but misses its boundaries. Without it a session with readings has one.
    Readings reduce to three rows per session before they meet the calendar.
    """
    day = F.col("session_date")
    rank = F.array(*[F.lit(b) for b in market.boundaries])
    present = boundary_presence(readings, market)
    if files is not None:
        listed = files.select("session_date", F.lit(None).cast("string").alias("boundary"), F.lit(False).alias("present"))
        present = present.unionByName(listed)
    seen = present.groupBy("session_date").agg(
        F.lit(True).alias("has_file"),
        F.collect_set(F.when(F.col("present") & F.col("boundary").isin(*market.boundaries),
                             F.col("boundary"))).alias("captured"))
    due = F.filter(rank, lambda b: is_due(b, day, as_of, market, force_all))
    checked = (
        calendar.select("session_date").distinct().join(seen, "session_date", "left")
        .withColumn("due", due)
        .withColumn("captured", F.coalesce("captured", F.array().cast("array<string>")))
        .withColumn("missing", F.array_except("due", "captured"))
    )
    status = (
        F.when(is_closed(day, market), "closed")
        .when(F.size("due") == 0, "not due")
        .when(F.col("has_file").isNull(), "file missing")
        .when(F.size("missing") > 0, "boundary missing")
        .otherwise("ok")
    )
    out = checked.withColumn("status", status)
    failed = F.col("status").isin("file missing", "boundary missing")
    joined = F.when(F.col("status").isin("closed", "not due"), "")
    return out.select(
        "session_date", "status", F.when(failed, 2).otherwise(0).alias("code"),
        joined.otherwise(F.array_join("due", ",")).alias("due"),
        F.when(failed, F.array_join("missing", ",")).otherwise("").alias("missing"))


def reconcile(left: DataFrame, right: DataFrame, outlier_pct: float = 5.0) -> DataFrame:
    """Per date and slot, two sources side by side with absolute and percent gap."""
    a = left.select("session_date", "generic_code", F.col("volume").alias("left_volume"))
    b = right.select("session_date", "generic_code", F.col("volume").alias("right_volume"))
    gap = F.col("left_volume") - F.col("right_volume")
    pct = ratio(gap, F.col("right_volume")) * 100
    state = (
        F.when(F.col("left_volume").isNull(), "right only").when(F.col("right_volume").isNull(), "left only")
        .when(F.abs(pct) > outlier_pct, "outlier").when(gap == 0, "equal").otherwise("close"))
    return a.join(b, ["session_date", "generic_code"], "full_outer") \
        .withColumn("gap", gap).withColumn("gap_pct", pct).withColumn("state", state)
