"""Windows from the files an index names, against the whole tape."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.tape import window_slots
from tidemark.sources import landed

DAYS = ("2026-06-17", "2026-06-18", "2026-06-22")
COLUMNS = "session_date string, snap_ts string, contract string, strike double, call_vol double, put_vol double"


def tape(spark, days=DAYS, polls=200, seed=1):
    """Polls from the evening before to the afternoon, some silent, a few without a time."""
    draw = random.Random(seed)
    rows = []
    for d in days:
        before = f"{d[:-2]}{int(d[-2:]) - 1:02d}"
        for p in range(polls):
            minute = 21 * 60 + p * 5 + draw.randrange(5)
            day, clock = (before, minute) if minute < 24 * 60 else (d, minute - 24 * 60)
            ts = f"{day} {clock // 60:02d}:{clock % 60:02d}:{draw.randrange(60):02d}"
            rows += [(d, ts, c, 60.0, float(p + k), float(p)) for k, c in enumerate(("CTZ6", "CTH7", "CTN7")) if draw.random() < 0.9]
    rows.append((days[0], None, "CTZ6", 60.0, 9.0, 9.0))
    return spark.createDataFrame(rows, COLUMNS).withColumn("session_date", F.col("session_date").cast("date")).withColumn(
        "snap_ts", F.col("snap_ts").cast("timestamp_ntz"))


def windows(df):
    return sorted(map(tuple, window_slots(df).select("session_date", "window", "generic_code", "call", "put", "total").collect()))


@pytest.mark.parametrize("tasks", [1, 5])
def test_windows_of_the_marked_files_are_those_of_the_tape(spark, tmp_path, tasks):
    rows = tape(spark)
    landed.land(rows.repartition(tasks), str(tmp_path), rows_per_file=40)
    read = landed.read_marked(spark, str(tmp_path))
    assert windows(read) == windows(rows) != []
    assert spark.read.parquet(str(tmp_path)).count() == rows.count()


def test_a_small_share_of_a_session_is_read(spark, tmp_path):
    rows = tape(spark, polls=205)
    landed.land(rows.coalesce(1), str(tmp_path), rows_per_file=20)
    files = landed.marked_files(spark, str(tmp_path))
    assert files.agg(F.sum("rows")).first()[0] < 0.2 * rows.count()
    assert landed.read_marked(spark, str(tmp_path)).count() == files.agg(F.sum("rows")).first()[0]


def test_a_session_is_landed_anew_with_its_index(spark, tmp_path):
    landed.land(tape(spark), str(tmp_path), rows_per_file=40)
    again = tape(spark, days=DAYS[1:2], seed=9)
    landed.land(again.filter("snap_ts is not null"), str(tmp_path), rows_per_file=30)
    want = tape(spark).filter(F.col("session_date") != F.lit(DAYS[1]).cast("date")).unionByName(again.filter("snap_ts is not null"))
    assert windows(landed.read_marked(spark, str(tmp_path))) == windows(want)


def test_a_poll_across_two_files_and_sessions_that_end_early(spark, tmp_path):
    rows = [("2026-06-17", "2026-06-17 06:59:00", f"CTZ{k}", 60.0, 1.0, 1.0) for k in range(9)]
    rows += [("2026-06-18", "2026-06-17 22:00:00", "CTZ6", 60.0, 5.0, 1.0), ("2026-06-22", "2026-06-22 20:00:00", "CTZ6", 60.0, 7.0, 1.0)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("session_date", F.col("session_date").cast("date")).withColumn("snap_ts", F.col("snap_ts").cast("timestamp_ntz"))
    landed.land(df.coalesce(1), str(tmp_path), rows_per_file=2)
    read = landed.read_marked(spark, str(tmp_path))
    assert read.filter("session_date = date'2026-06-17'").count() == 9 and windows(read) == windows(df)


def test_an_empty_tape(spark, tmp_path):
    landed.land(tape(spark), str(tmp_path))
    landed.land(tape(spark).filter("false"), str(tmp_path))
    assert landed.read_marked(spark, str(tmp_path)).count() > 0
