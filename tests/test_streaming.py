"""The same polls as a stream of several files and as one batch."""

from pyspark.sql import functions as F

from tidemark.operators import boundary as B
from tidemark.settings import Market
from tidemark.streaming import capture as L

SCHEMA = "session_date date, snap_ts timestamp_ntz, contract string, volume double, oi double"


def polls(spark, tmp_path, files):
    """Each inner list of (session, ts, contract, volume) is one file, read in order."""
    for i, rows in enumerate(files):
        spark.createDataFrame([(s, ts, c, v, None if v is None else 1.0) for s, ts, c, v in rows],
                              "s string, ts string, contract string, volume double, oi double").selectExpr(
            "cast(s as date) session_date", "cast(ts as timestamp_ntz) snap_ts", "contract", "volume", "oi"
        ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/polls")
    batch = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/polls")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/polls")
    return batch, stream


S1, S2 = "2026-06-17", "2026-06-18"
FILES = [
    [(S1, "2026-06-16 21:00:10", "CTZ6", 5.0), (S1, "2026-06-16 21:02:00", "CTH7", 7.0)],
    [(S1, "2026-06-17 02:00:00", "CTZ6", 50.0)],
    [(S1, "2026-06-17 07:01:00", "CTZ6", 60.0), (S1, "2026-06-17 07:00:30", "CTZ6", 58.0)],
    [(S1, "2026-06-17 14:40:00", "CTZ6", 90.0)],
    [(S2, "2026-06-17 21:10:00", "CTZ6", 1.0), (S2, "2026-06-18 03:00:00", "CTH7", 4.0)],
]


def test_stream_equals_batch(spark, tmp_path):
    batch, stream = polls(spark, tmp_path, FILES)
    got = L.latest_rows(L.run_available(L.capture_stream(stream)), ["session_date", "contract", "boundary"])
    cols = ["session_date", "contract", "boundary", "timestamp", "volume", "oi"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, B.capture_boundaries(batch).select(cols).collect()))


def test_append_mode_gives_closed_sessions_only(spark, tmp_path):
    _, stream = polls(spark, tmp_path, FILES)
    got = L.run_available(L.capture_stream(stream), mode="append")
    assert {str(r.session_date) for r in got.collect()} == {S1}


def test_interim_night_before_the_close(spark, tmp_path):
    _, stream = polls(spark, tmp_path, FILES[:2])
    got = {r.contract: (r.night, r.day, r.full) for r in L.latest_rows(L.run_available(L.live_windows(stream)), ["session_date", "contract"]).collect()}
    assert got == {"CTZ6": (45.0, None, 45.0), "CTH7": (0.0, None, 0.0)}


def test_live_windows_at_the_end(spark, tmp_path):
    _, stream = polls(spark, tmp_path, FILES)
    got = L.latest_rows(L.run_available(L.live_windows(stream)), ["session_date", "contract"]).filter(
        (F.col("session_date") == F.lit(S1).cast("date")) & (F.col("contract") == "CTZ6")).first()
    assert (got.night, got.day, got.full) == (53.0, 32.0, 85.0)


def test_alerts_only_for_unread_boundaries(spark, tmp_path):
    files = [*FILES, [(S2, "2026-06-18 07:02:00", "CTV6", 9.0)], [(S2, "2026-06-18 20:00:00", "CTZ6", 9.0)]]
    _, stream = polls(spark, tmp_path, files)
    got = sorted((str(r.session_date), r.boundary) for r in L.run_available(L.completeness_alerts(stream), mode="append").collect())
    # 14:20 was read at 14:40 only; the next open at 21:10 only; October does not count
    assert got == [(S1, "1420"), (S2, "0700"), (S2, "1420"), (S2, "open")]


def test_alerts_with_a_grace_that_does_not_divide_the_hour(spark, tmp_path):
    """21:02, 07:04 and 14:26 are read within seven minutes; 14:27 would not be."""
    files = [[(S1, "2026-06-16 21:02:00", "CTZ6", 5.0)], [(S1, "2026-06-17 07:04:59", "CTZ6", 60.0)],
             [(S1, "2026-06-17 14:26:59", "CTZ6", 90.0)], [(S2, "2026-06-17 21:07:00", "CTZ6", 1.0)], [(S2, "2026-06-18 06:00:00", "CTZ6", 4.0)]]
    _, stream = polls(spark, tmp_path, files)
    alerts = L.completeness_alerts(stream, Market(grace_minutes=7))
    got = sorted((str(r.session_date), r.boundary) for r in L.run_available(alerts, mode="append").collect())
    assert got == [(S2, "open")]


def ticks(spark, tmp_path, steps):
    """A stream of clock ticks, one file for each list of times, read in step with the polls."""
    for rows in steps:
        spark.createDataFrame([(t,) for t in rows], "t string").selectExpr("cast(t as timestamp_ntz) tick").coalesce(1) \
            .write.mode("append").parquet(f"{tmp_path}/ticks")
    return spark.readStream.schema("tick timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")


def alerts_of(spark, polls, beats):
    found = L.completeness_alerts(polls, beats=L.heartbeat(beats))
    return sorted((str(r.session_date), r.boundary) for r in L.run_available(found, mode="append").collect())


def test_sessions_without_a_poll_alert_all_boundaries(spark, tmp_path):
    _, stream = polls(spark, tmp_path, [FILES[0][:1], FILES[1], FILES[2], FILES[3]])
    beats = ticks(spark, tmp_path, [["2026-06-16 21:00:00", "2026-06-16 21:03:00"], ["2026-06-17 02:00:00"], ["2026-06-17 07:01:00"], ["2026-06-17 14:40:00"],
                                    ["2026-06-17 21:00:00"], ["2026-06-18 07:00:00"], ["2026-06-18 20:00:00"],
                                    # the 19th is a holiday, then a weekend, then Sunday's open
                                    ["2026-06-18 21:10:00"], ["2026-06-20 12:00:00"], ["2026-06-21 21:30:00"], ["2026-06-22 20:00:00"]])
    assert alerts_of(spark, stream, beats) == [(S1, "1420"), (S2, "0700"), (S2, "1420"), (S2, "open"),
                                               ("2026-06-22", "0700"), ("2026-06-22", "1420"), ("2026-06-22", "open")]


def test_ticks_alone_do_not_alert_before_the_grace_is_over(spark, tmp_path):
    _, stream = polls(spark, tmp_path, [[(S1, "2026-06-16 21:00:10", "CTZ6", 5.0)]])
    beats = ticks(spark, tmp_path, [["2026-06-16 21:00:30"], ["2026-06-17 07:12:00"]])
    assert alerts_of(spark, stream, beats) == []


def test_the_callers_session_keeps_its_settings(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    _, stream = polls(spark, tmp_path, FILES[:2])
    L.run_available(L.completeness_alerts(stream), mode="append")
    assert spark.conf.get(name, None) == before


def test_clock_ticks_are_a_stream_of_the_zone(spark):
    found = L.heartbeat(L.clock_ticks(spark, "America/New_York"))
    assert found.isStreaming and dict(found.dtypes) == {"session_date": "date", "snap_ts": "timestamp_ntz"}
