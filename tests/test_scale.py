"""Skewed inputs and plan shapes that matter on a large cluster."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.datasets import slices
from tidemark.operators import boundary as B
from tidemark.operators import sizing
from tidemark.operators import tape as T
from tidemark.operators.trailing import trailing
from tidemark.plans import futures as P
from tidemark.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_session_needs_a_shared_folder(monkeypatch):
    class Conf:
        values = {"spark.master": "spark://somewhere:7077"}

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        sizing.shared_folder(Session())
    Session.conf.values = {**Conf.values, "spark.checkpoint.dir": "hdfs:///ck"}
    assert sizing.shared_folder(Session()).startswith("hdfs:///ck/")


def test_hot_contract_is_aggregated_before_the_shuffle(spark):
    """All polls of one session belong to one contract: hash aggregation, partial first."""
    polls = spark.range(300_000).selectExpr(
        "date'2026-06-17' session_date", "timestamp_ntz'2026-06-16 21:00:00' + make_dt_interval(0, 0, 0, id % 60000) snap_ts",
        "'CTZ6' contract", "cast(id % 60000 as double) volume", "1.0D oi")
    df = B.capture_boundaries(polls)
    text = plan(df)
    assert "partial_min_by" in text and "SortAggregate" not in text and text.count("Exchange") == 1
    got = {r.boundary: r.volume for r in df.collect()}
    assert got == {"open": 0.0, "0700": 36000.0}


def test_slots_are_mapped_after_the_join_only(spark, tmp_path):
    rows = spark.range(1000).selectExpr(
        "date'2026-06-17' session_date", "timestamp_ntz'2026-06-17 00:00:00' + make_dt_interval(0, 0, 0, id) snap_ts",
        "'CTZ6' contract", "75.0D strike", "1.0D call_vol", "1.0D put_vol")
    sinks.land(rows, f"{tmp_path}/t")
    tape = spark.read.parquet(f"{tmp_path}/t")
    text = plan(T.window_slots(tape))
    scans = re.findall(r"ReadSchema: struct<([^>\n]*)", text)
    assert sorted(s.count(":") for s in scans) == [1, 4]
    # the code mapping sits above the join, so it runs on the chosen polls only
    assert text.index("_made") < text.index("BroadcastHashJoin") < text.index("FileScan")
    pruned = plan(T.window_slots(tape.filter("session_date = date'2026-06-17'")))
    assert "PartitionFilters: [isnotnull(session_date" in pruned


def test_all_tiers_share_one_sort(spark):
    df = spark.range(100).selectExpr("cast(id % 3 as string) k", "cast(id as int) d", "cast(id as double) v")
    text = plan(trailing(df, ["k"], "d", "v"))
    assert len(re.findall(r"Window \[", text)) == 1 and len(re.findall(r"\bSort \[", text)) == 1
    assert text.count("Exchange") == 1


def test_hot_series_key_is_one_row_per_date_before_the_window(spark):
    """A third of all rows on one date and slot: summed before the window sees them."""
    lines = spark.range(90_000).selectExpr(
        "case when id < 30000 then date'2026-06-15' else date_add(date'2026-01-01', cast(id % 100 as int)) end session_date",
        "'CTDEC1' generic", "1.0D volume")
    daily = lines.groupBy("session_date", "generic").agg(F.sum("volume").alias("volume"))
    totals = P.seed_totals(daily)
    out = trailing(totals.withColumn("k", F.lit("CT")), ["k"], "session_date", "full")
    last = out.filter("tier = 5").orderBy(F.desc("session_date")).first()
    assert (str(last.session_date), last.full, last.avg) == ("2026-06-15", 30000.0, 600.0)


def test_latest_overall_is_a_scan_filter(spark, tmp_path):
    spark.range(100).selectExpr("date_add(date'2026-01-01', cast(id % 10 as int)) date", "id").write.parquet(f"{tmp_path}/d")
    df = slices.latest(spark.read.parquet(f"{tmp_path}/d"), "date")
    assert "Join" not in plan(df) and "Window" not in plan(df) and df.count() == 10


def test_latest_per_key(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 2, 2), ("A", 2, 3), ("B", 1, 4)], "k string, date int, v int")
    assert sorted(r.v for r in slices.latest(df, "date", ["k"]).collect()) == [2, 3, 4]


@pytest.mark.parametrize("given,want", [(None, 52), ("x", 52), (-3, 52), (0, 52), ("104", 104), (9999, 700)])
def test_weeks_with_limits_of_the_caller(given, want):
    assert slices.weeks_or_default(given, default=52, most=700) == want


def test_weeks_are_not_limited_otherwise():
    assert slices.weeks_or_default("x") is None and slices.weeks_or_default(9999) == 9999


def test_invalid_filters_are_refused(spark):
    from tidemark.datasets.interest import options_history
    df = spark.createDataFrame([("CT", "C")], "commodity string, put_call string")
    with pytest.raises(ValueError, match="XX"):
        options_history(df, commodity="XX")
    with pytest.raises(ValueError, match="put/call"):
        options_history(df, pc="Q")
    assert options_history(df, commodity="ct", pc="c").count() == 1


def test_a_scope_removes_its_own_folders_only(spark):
    from tidemark.operators.sizing import scope, written

    mine = written(spark.range(3).toDF("x"))
    with scope(spark):
        inner = written(spark.range(5).toDF("x"))
        assert inner.count() == 5
    assert mine.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        inner.count()
