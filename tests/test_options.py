import pytest
from builders import tape_df, tape_row, write_tape
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import tape as T
from tidemark.plans import options as P
from tidemark.sources.market import read_tape, session_files
from tidemark.sources.versions import read_table

D = "2026-06-17"


def slots(df, window):
    return {r.generic_code: (r.call, r.put) for r in T.window_slots(df).filter(F.col("window") == window).collect()}


def test_overnight_reads_the_last_poll_before_seven(spark):
    df = tape_df(spark, [(D, "2026-06-16 21:00:02", "CTZ6", 10, 20), (D, f"{D} 06:59:58", "CTZ6", 100, 200),
                         (D, f"{D} 06:59:58", "CTZ6", 50, 30), (D, f"{D} 07:00:19", "CTZ6", 900, 900),
                         (D, f"{D} 14:20:07", "CTZ6", 999, 999)])
    assert slots(df, "overnight") == {"CTDEC1": (150.0, 230.0)}
    marks = T.marks(df).first()
    assert str(marks.overnight_ts) == f"{D} 06:59:58" and str(marks.day_start_ts) == f"{D} 07:00:19"


def test_poll_at_exactly_seven_belongs_to_the_night(spark):
    df = tape_df(spark, [(D, f"{D} 06:59:40", "CTZ6", 1, 1), (D, f"{D} 07:00:00", "CTZ6", 5, 6)])
    assert slots(df, "overnight") == {"CTDEC1": (5.0, 6.0)}


def test_no_poll_before_seven(spark):
    df = tape_df(spark, [(D, f"{D} 07:30:00", "CTZ6", 5, 6)])
    run = P.options_sessions(df)
    assert slots(df, "overnight") == {} and run.totals.count() == 0
    s = run.status.first()
    assert (s.has_overnight, s.has_day, s.code) == (False, False, 0) and "no overnight" in s.warning
    assert run.history.first().overnight_total is None


def test_excluded_months_never_appear(spark):
    df = tape_df(spark, [(D, f"{D} 06:00:00", c, v, v) for c, v in (("CTV6", 999), ("CTQ6", 999), ("CTZ6", 3), ("KCZ6", 8))])
    assert slots(df, "overnight") == {"CTDEC1": (3.0, 3.0)}


def test_contract_missing_from_the_poll_contributes_nothing(spark):
    df = tape_df(spark, [(D, f"{D} 06:00:00", "CTH7", 40, 40), (D, f"{D} 06:30:00", "CTZ6", 3, 4)])
    assert slots(df, "overnight") == {"CTDEC1": (3.0, 4.0)}


def test_serials_fold_into_their_parent(spark):
    df = tape_df(spark, [(D, f"{D} 06:00:00", "CTU6", 99, 77), (D, f"{D} 06:00:00", "CTZ6", 10, 5),
                         (D, f"{D} 06:00:00", "CTF7", 55, 33)])
    assert slots(df, "overnight") == {"CTDEC1": (109.0, 82.0), "CTMAR1": (55.0, 33.0)}


def test_day_is_a_difference(spark):
    df = tape_df(spark, [(D, f"{D} 07:00:19", "CTZ6", 100, 200), (D, f"{D} 14:20:07", "CTZ6", 350, 500)])
    assert slots(df, "day") == {"CTDEC1": (250.0, 300.0)}


def test_day_needs_two_polls_and_clamps(spark):
    assert slots(tape_df(spark, [(D, f"{D} 07:00:19", "CTZ6", 100, 200)]), "day") == {}
    df = tape_df(spark, [(D, f"{D} 07:00:19", "CTZ6", 100, 200), (D, f"{D} 14:20:07", "CTZ6", 50, 260)])
    assert slots(df, "day") == {"CTDEC1": (0.0, 60.0)}


def test_day_is_a_full_outer_difference(spark):
    df = tape_df(spark, [(D, f"{D} 07:00:00", "CTH7", 7, 7), (D, f"{D} 14:00:00", "CTZ6", 5, 6)])
    assert slots(df, "day") == {"CTMAR1": (0.0, 0.0), "CTDEC1": (5.0, 6.0)}


def test_summary_and_empty_window(spark):
    df = tape_df(spark, [(D, f"{D} 06:00:00", "CTZ6", 100, 200), (D, f"{D} 06:00:00", "CTH7", 50, 50),
                         ("2026-06-18", "2026-06-18 06:00:00", "CTV6", 1, 1)])
    t = {str(r.session_date): r for r in P.options_sessions(df).totals.collect()}
    assert t[D].total == 400 and t[D].pc_ratio == pytest.approx(250 / 150)
    assert t["2026-06-18"].total == 0 and t["2026-06-18"].pc_ratio is None


def test_holiday_produces_nothing(spark):
    df = tape_df(spark, [("2026-12-25", "2026-12-25 06:00:00", "CTZ6", 1, 1)])
    run = P.options_sessions(df)
    assert run.history.count() == 0 and run.report.count() == 0


def many(spark):
    rows = []
    for d in range(1, 13):
        s = f"2026-06-{d:02d}"
        for h, k in ((1, 1), (6, 2), (7, 3), (12, 5), (14, 7)):
            rows += [(s, f"{s} {h:02d}:00:10", c, k * d + i, k * d * 2 + i) for i, c in enumerate(("CTZ6", "CTU6", "CTH7", "CTV6"))]
    return tape_df(spark, rows)


def test_many_sessions_in_one_plan_equal_one_by_one(spark):
    df = many(spark)
    whole = sorted(map(tuple, T.window_slots(df).collect()))
    single = []
    for d in range(1, 13):
        single += map(tuple, T.window_slots(df.filter(F.col("session_date") == F.lit(f"2026-06-{d:02d}").cast("date"))).collect())
    assert whole == sorted(single) and whole


def test_same_result_without_a_broadcast(spark):
    want = sorted(map(tuple, T.window_slots(many(spark)).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = T.window_slots(many(spark))
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_session_holding_most_rows(spark):
    """One session with nearly all rows: sums are right and nothing is shuffled by poll."""
    hot = spark.range(200_000).selectExpr(
        f"date'{D}' session_date", f"timestamp_ntz'{D} 00:00:00' + make_dt_interval(0, 0, 0, id % 40000) snap_ts",
        "'CTZ6' contract", "75.0D strike", "1.0D call_vol", "2.0D put_vol")
    df = hot.unionByName(tape_df(spark, [("2026-06-18", "2026-06-18 05:00:00", "CTZ6", 4, 5)]))
    got = {str(r.session_date): (r.call, r.put) for r in T.window_slots(df).filter("window = 'overnight'").collect()}
    assert got == {D: (5.0, 10.0), "2026-06-18": (4.0, 5.0)}


def test_impact_universe_equals_slot_totals(spark):
    df = many(spark)
    impact = {(r.session_date, r.window): r.total_universe for r in T.filter_impact(df).collect()}
    totals = {(r.session_date, r.window): r.total for r in P.options_sessions(df).totals.collect()}
    assert impact == totals
    assert all(r.total >= r.total_universe for r in T.filter_impact(df).collect())


def test_history_and_priors(spark):
    rows = [(f"2026-06-{d}", "ct", o, v) for d, o, v in ((14, 300.0, 800.0), (15, 400.0, 1000.0), (16, 500.0, 1200.0))]
    hist = spark.createDataFrame(rows, "date string, commodity string, overnight_total double, day_total double") \
        .withColumn("date", F.col("date").cast("date"))
    cur = tape_df(spark, [(D, f"{D} 06:00:00", "CTZ6", 300, 500)])
    run = P.options_sessions(cur, hist, accumulate=False)
    five = run.rvol.filter("tier = 5").first()
    assert (five.n, five.avg, five.prev) == (3, 400.0, 500.0) and five.rvol == pytest.approx(2.0)
    assert five.note == "n/a (have 3 of 5)" and five.flag == "HIGH"
    strict = P.options_sessions(cur, hist, accumulate=False, mode="strict").rvol.filter("tier = 5").first()
    assert strict.rvol is None and strict.avg is None and strict.available is False


def test_rewriting_a_session_replaces_it_in_its_own_history(spark):
    hist = spark.createDataFrame([(D, "CT", 7.0, None)], "date string, commodity string, overnight_total double, day_total double") \
        .withColumn("date", F.col("date").cast("date"))
    run = P.options_sessions(tape_df(spark, [(D, f"{D} 06:00:00", "CTZ6", 3, 5)]), hist)
    assert run.rvol.filter("tier = 5").first().n == 0


def test_report_text(spark):
    df = tape_df(spark, [("2026-06-16", "2026-06-16 06:00:00", "CTZ6", 1000, 1000), (D, f"{D} 06:00:00", "CTZ6", 3000, 1500)])
    lines = [r.line for r in P.options_sessions(df, generated_at="2026-06-17 15:00:00").report
             .filter(F.col("session_date") == F.lit(D).cast("date")).orderBy("section", "ord").collect()]
    assert lines[:2] == [f"SESSION VOLUME -- CT -- {D}", "=" * 60]
    assert "  Total          : 4,500" in lines
    assert "  Calls / Puts   : 3,000 / 1,500   (P/C 0.50)" in lines
    assert "  vs prev session: 2,000   UP +125%" in lines
    assert "  RVOL- 5  avg=    2,000  rvol=2.25x  *** HIGH (>=2x)  [n/a (have 1 of 5)]" in lines
    assert "    CTDEC1   (CTZ6/2026)      4,500  |     3,000  |     1,500" in lines
    assert "  No data for this window." in lines and lines[-1] == "Generated: 2026-06-17T15:00:00"


def test_csv_tapes_and_session_discovery(spark, tmp_path):
    for d, k in (("2026-06-15", 1), (D, 2)):
        write_tape(tmp_path, d, [tape_row(f"{d} 06:00:00", "CTZ6", 10 * k, 5 * k), tape_row(f"{d} 06:00:00", "CTZ6", "n/a", "", 80)])
    write_tape(tmp_path, "notes", [])
    found = session_files(spark, str(tmp_path), "ct_options_tape.csv")
    assert sorted(str(r.session_date) for r in found.collect()) == ["2026-06-15", D]
    totals = {str(r.session_date): r.total for r in P.options_sessions(read_tape(spark, str(tmp_path))).totals.collect()}
    assert totals == {"2026-06-15": 15.0, D: 30.0}


def test_missing_tape_names_the_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="2026-06-17"):
        read_tape(spark, str(tmp_path), session=D)


def test_job_writes_everything_once_and_dry_run_nothing(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    for d in ("2026-06-15", "2026-06-16", D):
        write_tape(root, d, [tape_row(f"{d} 06:00:00", "CTZ6", 10, 5), tape_row(f"{d} 07:00:10", "CTZ6", 11, 6),
                             tape_row(f"{d} 14:20:00", "CTZ6", 31, 16)])
    assert jobs.run_options(spark, str(root), str(out), write=False) == 0 and not out.exists()
    assert jobs.run_options(spark, str(root), str(out), session="2026-12-25") == 0 and not out.exists()
    assert jobs.run_options(spark, str(tmp_path / "nowhere"), str(out)) == 1
    for _ in range(2):
        assert jobs.run_options(spark, str(root), str(out), backfill=True) == 0
    hist = read_table(spark, f"{out}/history/session_volume")
    assert sorted((str(r.date), r.overnight_total, r.day_total) for r in hist.collect()) == [
        ("2026-06-15", 15.0, 30.0), ("2026-06-16", 15.0, 30.0), (D, 15.0, 30.0)]
    # an overnight-only run replaces the whole row of its date and nothing else
    assert jobs.run_options(spark, str(root), str(out), session=D, window="overnight") == 0
    hist = {str(r.date): r.day_total for r in read_table(spark, f"{out}/history/session_volume").collect()}
    assert hist == {"2026-06-15": 30.0, "2026-06-16": 30.0, D: None}
    # a file without a readable poll makes the run fail, but the others are written
    write_tape(root, "2026-06-18", [tape_row("no time at all", "CTZ6", 1, 1)])
    write_tape(root, "2026-06-22", [tape_row("2026-06-22 06:00:00", "CTZ6", 10, 5)])
    assert jobs.run_options(spark, str(root), str(out), backfill=True) == 1
    assert {str(r.date) for r in read_table(spark, f"{out}/history/session_volume").collect()} >= {D, "2026-06-22"}
    assert jobs.run_options(spark, str(root), str(out), session=D, window="overnight") == 0
    doc = spark.read.json(f"{out}/session_volume").filter(F.col("session_date") == D).first()
    assert (doc.date, doc.window, doc.day) == (D, "overnight", None)
    assert doc.overnight.per_contract.CTDEC1.ice_code == "CTZ6" and doc.overnight.snapshot_ts == f"{D} 06:00:00"
    doc = spark.read.json(f"{out}/session_volume_windows").filter(F.col("session_date") == D).first()
    assert doc.windows.overnight.total == 15.0 and doc.windows.overnight.by_contract[0].generic_code == "CTDEC1"
    text = [r.value for r in spark.read.text(f"{out}/session_volume_report/session_date={D}").collect()]
    assert text[0] == f"SESSION VOLUME -- CT -- {D}" and "  Total          : 15" in text
