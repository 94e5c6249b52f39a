import pytest
from builders import boundary_rows, readings_df, write_sidecar
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import boundary as B
from tidemark.operators import coverage as C

DAYS = ("2026-06-16", "2026-06-17", "2026-06-18", "2026-06-19", "2026-06-20")


def check(spark, readings, now, **kw):
    cal = spark.createDataFrame([(d,) for d in DAYS], "d string").selectExpr("cast(d as date) session_date")
    out = C.capture_check(cal, readings, F.lit(now).cast("timestamp_ntz"), **kw)
    return {str(r.session_date): (r.status, r.code, r.missing) for r in out.collect()}


def test_states(spark):
    full = [("2026-06-16", "CTZ6", b, 1) for b in ("open", "0700", "1420")]
    part = [("2026-06-17", "CTZ6", "open", 1), ("2026-06-17", "CTV6", "0700", 1)]
    got = check(spark, readings_df(spark, full + part), "2026-06-17 07:05:00")
    assert got["2026-06-16"] == ("ok", 0, "")
    assert got["2026-06-17"] == ("boundary missing", 2, "0700")
    assert got["2026-06-18"] == ("not due", 0, "")
    assert got["2026-06-19"][0] == "closed" and got["2026-06-20"][0] == "closed"


@pytest.mark.parametrize("now,status", [("2026-06-17 07:04:59", "ok"), ("2026-06-17 07:05:00", "boundary missing"),
                                        ("2026-06-16 22:00:00", "not due"), ("2026-06-18 00:00:00", "boundary missing")])
def test_grace(spark, now, status):
    r = readings_df(spark, [("2026-06-17", "CTZ6", "open", 1)])
    assert check(spark, r, now)["2026-06-17"][0] == status


def test_file_missing_and_forced_end_of_day(spark):
    r = readings_df(spark, [("2026-06-16", "CTZ6", "open", 1)])
    assert check(spark, r, "2026-06-17 00:10:00")["2026-06-17"] == ("file missing", 2, "open")
    assert check(spark, r, "2026-06-01 00:00:00", force_all=True)["2026-06-16"] == ("boundary missing", 2, "0700,1420")


def test_slot_spelling_does_not_count_as_captured(spark):
    r = readings_df(spark, [("2026-06-16", "CTDEC1", "open", 1)])
    assert [x.present for x in C.boundary_presence(r).collect()] == [False]


def test_check_job(spark, tmp_path):
    d = "2026-06-17"
    assert jobs.run_check(spark, str(tmp_path), "2026-06-20") == 0
    assert jobs.run_check(spark, str(tmp_path), d, now="2026-06-18 00:00:00") == 2
    write_sidecar(tmp_path, d, [])
    assert jobs.run_check(spark, str(tmp_path), d, now="2026-06-18 00:00:00") == 2
    files = spark.createDataFrame([(d,)], "d string").selectExpr("cast(d as date) session_date")
    assert check(spark, readings_df(spark, [("2026-06-16", "CTZ6", "open", 1)]), "2026-06-18 00:00:00", files=files)[d] \
        == ("boundary missing", 2, "open,0700,1420")
    write_sidecar(tmp_path, d, boundary_rows(d, "CTZ6", 1, 2))
    assert jobs.run_check(spark, str(tmp_path), d, now="2026-06-17 14:00:00") == 0
    assert jobs.run_check(spark, str(tmp_path), d, now="2026-06-17 14:00:00", eod=True) == 2


def test_capture_takes_first_poll_on_or_after_each_boundary(spark):
    polls = spark.createDataFrame(
        [("2026-06-17", ts, "CTZ6", v, oi) for ts, v, oi in (
            ("2026-06-16 20:59:50", 5.0, 1.0), ("2026-06-16 21:00:00", 6.0, 1.0), ("2026-06-16 21:00:20", 7.0, 1.0),
            ("2026-06-17 06:59:59", 50.0, 1.0), ("2026-06-17 07:00:05", None, None), ("2026-06-17 07:03:00", None, 9.0),
            ("2026-06-17 07:04:00", 60.0, 9.0))],
        "d string, ts string, contract string, volume double, oi double").selectExpr(
        "cast(d as date) session_date", "cast(ts as timestamp_ntz) snap_ts", "contract", "volume", "oi")
    got = {r.boundary: (str(r.timestamp), r.volume, r.oi) for r in B.capture_boundaries(polls).collect()}
    assert got == {"open": ("2026-06-16 21:00:00", 6.0, 1.0), "0700": ("2026-06-17 07:03:00", None, 9.0)}


def test_counter_reset(spark):
    rows = [("2026-06-16", "CTZ6", "open", 10), ("2026-06-16", "CTZ6", "1420", 500), ("2026-06-17", "CTZ6", "open", 3),
            ("2026-06-17", "CTZ6", "1420", 700), ("2026-06-18", "CTZ6", "open", 700)]
    got = {str(r.session_date): r.state for r in B.counter_resets(readings_df(spark, rows)).collect()}
    assert got == {"2026-06-16": None, "2026-06-17": "reset", "2026-06-18": "carried"}


def test_coverage(spark):
    from builders import SEED, bars_df
    bars = bars_df(spark, SEED)
    c = C.coverage(bars).first()
    assert (str(c.first_date), str(c.last_date), c.n_dates) == ("2026-06-15", "2026-06-17", 3)
    assert {r.generic: r.n_days for r in C.nonzero_days(bars).collect()} == {"CTDEC1": 3, "CTMAR1": 3, "CTJUL1": 1, "CTOCT1": 1}
