from pathlib import Path

import pytest
from builders import SEED, SIDECAR_HEADER, bars_df, boundary_rows, readings_df, write_csv, write_sidecar
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import boundary as B
from tidemark.operators import trailing as R
from tidemark.plans import futures as P
from tidemark.settings import BAR_COLUMNS
from tidemark.sources.market import clean_bars, read_bars, read_sidecar
from tidemark.sources.versions import read_table

D = "2026-06-17"


def three(contract, a=None, b=None, c=None, session=D):
    return [(session, contract, n, v) for n, v in (("open", a), ("0700", b), ("1420", c)) if v is not None]


def windows(spark, rows):
    return {r.generic_code: (r.night, r.day, r.full) for r in B.boundary_windows(readings_df(spark, rows)).collect()}


def test_boundaries_become_windows(spark):
    assert windows(spark, three("CTDEC1", 1000, 1600, 2600)) == {"CTDEC1": (600.0, 1000.0, 1600.0)}


def test_october_only_and_partial_contracts(spark):
    assert windows(spark, three("CTOCT1", 1, 2, 3)) == {}
    assert windows(spark, three("CTMAR1", 1, 2) + three("CTDEC1", 1, 2, 3)) == {"CTDEC1": (1.0, 1.0, 2.0)}


def test_exchange_codes(spark):
    assert windows(spark, three("CTZ6", 100, 700, 900) + three("CTV6", 1, 2, 3)) == {"CTDEC1": (600.0, 200.0, 800.0)}


def test_exchange_spelling_wins_unless_incomplete(spark):
    both = three("CTDEC1", 0, 1, 2) + three("CTZ6", 0, 10, 20)
    assert windows(spark, both) == {"CTDEC1": (10.0, 10.0, 20.0)}
    partial = three("CTDEC1", 0, 1, 2) + three("CTZ6", 0, 10)
    assert windows(spark, partial) == {"CTDEC1": (1.0, 1.0, 2.0)}


def test_last_non_null_reading_wins(spark):
    rows = three("CTZ6", 100, 200, 300) + [(D, "CTZ6", "open", 50), (D, "CTZ6", "open", None)]
    assert windows(spark, rows) == {"CTDEC1": (150.0, 100.0, 250.0)}


def test_clamped_before_adding_and_zero_dropped(spark):
    assert windows(spark, three("CTZ6", 500, 100, 300)) == {"CTDEC1": (0.0, 200.0, 200.0)}
    assert windows(spark, three("CTZ6", 500, 400, 300)) == {}


def test_ratios(spark):
    slots = spark.createDataFrame([(D, "live", 30.0, 70.0, 100.0), ("2026-06-16", "seed", None, None, 50.0)],
                                  "session_date string, source string, night double, day double, full double")
    t = {r.session_date: r for r in B.session_totals(slots).collect()}
    assert t[D].night_share == pytest.approx(0.30) and t[D].night_day_ratio == pytest.approx(30 / 70)
    old = t["2026-06-16"]
    assert (old.night, old.day, old.full, old.night_share, old.night_day_ratio) == (None, None, 50.0, None, None)


def seed(spark):
    return clean_bars(bars_df(spark, SEED))


def test_seed_totals_and_priors(spark):
    bars = seed(spark)
    assert bars.count() == 7  # blanks and October are skipped
    totals = P.seed_totals(bars)
    five = R.trailing(totals.withColumn("k", F.lit(1)), ["k"], "session_date", "full").filter(
        (F.col("tier") == 5) & (F.col("session_date") == F.lit(D).cast("date"))).first()
    assert (five.prev, five.n, five.avg) == (44000.0, 2, 41000.0)
    raw = P.seed_totals(bars_df(spark, SEED)).filter(F.col("session_date") == F.lit("2026-06-15").cast("date")).first()
    assert raw.full == 38999.0


def test_readings_win_over_bars_per_session(spark):
    r = readings_df(spark, three("CTZ6", 100, 700, 900))
    t = {str(x.session_date): (x.source, x.full, x.n_contracts) for x in P.futures_sessions(r, seed(spark)).totals.collect()}
    assert t == {"2026-06-15": ("seed", 38000.0, 2), "2026-06-16": ("seed", 44000.0, 2), D: ("live", 800.0, 1)}
    s = {str(x.session_date): x.source for x in P.futures_sessions(r, seed(spark), prefer_seed=True).totals.collect()}
    assert s[D] == "seed"


def test_full_compares_with_bars_and_night_with_history(spark):
    r = readings_df(spark, three("CTZ6", 100, 700, 900))
    hist = spark.createDataFrame([("2026-06-16", "CT", 300.0, 100.0)], "date string, commodity string, night_total double, day_total double") \
        .withColumn("date", F.col("date").cast("date"))
    run = P.futures_sessions(r, seed(spark), hist, accumulate=False)
    got = {x.metric: x for x in run.rvol.filter((F.col("tier") == 5) & (F.col("session_date") == F.lit(D).cast("date"))).collect()}
    assert got["full"].avg == 41000.0 and got["full"].n == 2
    assert got["night"].rvol == pytest.approx(2.0) and got["day"].rvol == pytest.approx(2.0)
    blank = run.rvol.filter((F.col("metric") == "night") & (F.col("session_date") == F.lit("2026-06-16").cast("date"))).first()
    assert blank.rvol is None and blank.avg is None and blank.note.startswith("n/a (have")


@pytest.mark.parametrize("n,note,avg", [(60, None, 100.0), (3, "n/a (have 3 of 5)", 100.0), (0, "n/a (have 0 of 5)", None)])
def test_rvol_lookback(spark, n, note, avg):
    df = spark.range(n + 1).select(F.lit("k").alias("k"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
                                   F.when(F.col("id") == n, 200.0).otherwise(100.0).alias("v"))
    rows = {r.tier: r for r in R.trailing(df, ["k"], "d", "v").filter(F.col("v") == 200).collect()}
    assert (rows[5].note, rows[5].avg) == (note, avg) and rows[5].n == min(n, 5)
    assert rows[5].rvol == (2.0 if n else None)
    if n == 60:
        assert rows[60].rvol == 2.0 and rows[60].flag == "HIGH"


def test_blank_sessions_are_skipped_not_counted(spark):
    df = spark.createDataFrame([("k", 1, 10.0), ("k", 2, None), ("k", 3, 30.0), ("k", 4, 40.0)], "k string, d int, v double")
    assert {r.d: r.priors for r in R.prior_values(df, ["k"], "d", "v", 5).collect()} == {1: [], 3: [10.0], 4: [30.0, 10.0]}
    row = R.trailing(df, ["k"], "d", "v").filter("d = 4 and tier = 5").first()
    assert (row.n, row.avg) == (2, 20.0)


def test_zero_average_and_zero_previous(spark):
    df = spark.createDataFrame([("k", 1, 0.0), ("k", 2, 5.0)], "k string, d int, v double")
    r = R.trailing(df, ["k"], "d", "v").filter("d = 2 and tier = 5").first()
    assert r.avg == 0.0 and r.rvol is None and r.flag is None
    p = R.previous_session(df, ["k"], "d", "v").filter("d = 2").first()
    assert (p.prev, p.change_pct, p.direction) == (0.0, None, "UP")


def test_trailing_against_equals_trailing_on_the_same_series(spark):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("int").alias("d"),
                                 (F.col("id") * 7 % 11).cast("double").alias("v"))
    a = R.trailing(df, ["k"], "d", "v")
    b = R.trailing_against(df, df, ["k"], "d", "v")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_backtest_is_dry_and_limited(spark):
    run = P.backtest(readings_df(spark, three("CTZ6", 1, 2, 3, session="2026-01-05")), seed(spark), 2)
    assert not run.writable
    assert sorted(str(r.session_date) for r in run.totals.collect()) == ["2026-06-16", D]


def test_refresh_replaces_recent_bars_and_recomputes_yesterday(spark):
    pulled = bars_df(spark, [("2026-06-17", "CTDEC1", 40000), ("2026-05-01", "CTDEC1", 1), ("2026-06-16", "CTMAY1", 5)])
    none = readings_df(spark, []).filter("false")
    merged, run = P.refresh(none, seed(spark), pulled, F.lit("2026-06-18").cast("date"), 15)
    got = {(str(r.session_date), r.generic): r.volume for r in merged.collect()}
    assert got[(D, "CTDEC1")] == 40000.0 and ("2026-05-01", "CTDEC1") not in got and got[("2026-06-16", "CTMAY1")] == 5.0
    assert len(got) == 8
    assert [(str(r.session_date), r.full) for r in run.totals.collect()] == [(D, 40000.0 + 10204 + 7673)]


def test_contract_history_symbology(spark):
    rows = {(str(r.date), r.generic_code): r for r in P.seed_ingest(seed(spark))[1].collect()}
    r = rows[(D, "CTDEC1")]
    assert (r.ice_code, r.delivery_year, rows[(D, "CTMAR1")].ice_code) == ("CTZ6", 2026, "CTH7")


def test_holiday(spark):
    run = P.futures_sessions(readings_df(spark, three("CTZ6", 1, 2, 3, session="2026-05-25")), seed(spark).filter("false"))
    assert run.totals.count() == 0


def test_sidecar_schema_guard(spark, tmp_path):
    assert read_sidecar(spark, str(tmp_path)).count() == 0
    rows = boundary_rows(D, "CTZ6", 100, 700, 900)
    write_sidecar(tmp_path / "a", D, rows, [c for c in SIDECAR_HEADER if c != "volume"])
    with pytest.raises(ValueError, match="volume") as exc:
        read_sidecar(spark, str(tmp_path / "a"))
    assert "ct_futures_volume.csv" in str(exc.value)
    write_sidecar(tmp_path / "b", D, rows, [*SIDECAR_HEADER, "extra"])
    got = B.boundary_windows(read_sidecar(spark, str(tmp_path / "b"))).first()
    assert (got.generic_code, got.full) == ("CTDEC1", 800.0)


def test_labels_0700_and_1420_stay_text(spark, tmp_path):
    write_sidecar(tmp_path, D, boundary_rows(D, "CTZ6", None, 700, 900))
    assert {r.boundary for r in read_sidecar(spark, str(tmp_path)).collect()} == {"0700", "1420"}


def bars_csv(path, rows):
    return write_csv(path, list(BAR_COLUMNS), [dict(date=d, generic=g, ticker=f"{g} Comdty", volume="" if v is None else v) for d, g, v in rows])


def test_futures_job(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    bars = bars_csv(tmp_path / "bars.csv", SEED)
    write_sidecar(root, D, boundary_rows(D, "CTZ6", 100, 700, 900))
    args = (spark, str(root), str(out), bars)
    assert jobs.run_futures(*args[:3], str(tmp_path / "none.csv"), session=D) == 1
    assert jobs.run_futures(*args, session="2026-05-25") == 0 and not out.exists()
    assert jobs.run_futures(*args, session=D, window="overnight") == 0 and not out.exists()
    assert jobs.run_futures(*args, backtest=2) == 0 and not out.exists()
    assert jobs.run_futures(*args, session="2026-05-25", backtest=2, write=False) == 0
    assert jobs.run_futures(*args, seed=True) == 0
    for _ in range(2):
        assert jobs.run_futures(*args, session=D) == 0
    rows = sorted((str(r.date), r.full_total, r.source) for r in read_table(spark, f"{out}/history/futures_session_volume").collect())
    assert rows == [("2026-06-15", 38000.0, "seed"), ("2026-06-16", 44000.0, "seed"), (D, 800.0, "live")]
    doc = spark.read.json(f"{out}/futures_session_volume").first()
    assert (doc.date, doc.window, doc.summary.source, doc.ratios.night_share) == (D, "eod", "live", 0.75)
    assert doc.summary.per_contract.CTDEC1.position == 1
    contracts = read_table(spark, f"{out}/history/futures_session_volume_by_contract").filter(F.col("date") == F.lit(D).cast("date"))
    # rows of the same key are replaced, other contracts of the date stay
    assert {r.generic_code: r.full for r in contracts.collect()} == {"CTDEC1": 800.0, "CTMAR1": 10204.0, "CTJUL1": 7673.0}


def test_refresh_job(spark, tmp_path):
    bars = bars_csv(tmp_path / "bars.csv", SEED)
    pulled = bars_csv(tmp_path / "pulled.csv", [(D, "CTDEC1", 40000), ("2026-01-02", "CTDEC1", 9)])
    assert jobs.run_refresh(spark, str(tmp_path / "in"), str(tmp_path / "out"), bars, pulled, "2026-06-18") == 0
    hist = {str(r.date): r.full_total for r in read_table(spark, f"{tmp_path}/out/history/futures_session_volume").collect()}
    assert hist == {D: 57877.0}
    stored = read_table(spark, f"{tmp_path}/out/bars")
    assert stored.count() == 9 and set(BAR_COLUMNS[2:]) <= set(stored.columns)
    # a blank re-pull replaces the row, and the seed skips it
    blank = bars_csv(tmp_path / "blank.csv", [(D, "CTDEC1", None)])
    assert jobs.run_refresh(spark, str(tmp_path / "in"), str(tmp_path / "out"), bars, blank, "2026-06-18") == 0
    stored = {(str(r.session_date), r.generic): r.volume for r in read_table(spark, f"{tmp_path}/out/bars").collect()}
    assert stored[D, "CTDEC1"] is None and len(stored) == 9
    hist = {str(r.date): r.full_total for r in read_table(spark, f"{tmp_path}/out/history/futures_session_volume").collect()}
    assert hist == {D: 17877.0}


def test_a_job_removes_its_scratch_tables(spark, tmp_path):
    bars = bars_csv(tmp_path / "bars.csv", SEED)
    scratch = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(scratch.iterdir())
    assert jobs.main(["futures", "--root", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--bars", bars, "--seed"]) == 0
    assert (tmp_path / "out").exists() and set(scratch.iterdir()) <= before


def test_bars_csv_last_row_wins(spark, tmp_path):
    path = bars_csv(tmp_path / "bars.csv", [(D, "CTDEC1", 1), (D, "ctdec1 ", 2), (D, "CTDEC1", None), (D, "CTDEC3", 5), ("", "CTDEC1", 5)])
    assert [(r.generic, r.volume) for r in clean_bars(read_bars(spark, path)).collect()] == [("CTDEC1", 2.0)]


def test_many_sessions_equal_one_by_one(spark):
    rows = []
    for d in range(1, 6):
        rows += three("CTZ6", 10 * d, 20 * d, 35 * d, session=f"2026-06-0{d}") + three("CTH7", d, 3 * d, 3 * d, session=f"2026-06-0{d}")
    readings, none = readings_df(spark, rows), seed(spark).filter("false")
    whole = sorted(map(str, P.futures_sessions(readings, none).totals.collect()))
    single = []
    for d in range(1, 6):
        one = readings.filter(F.col("session_date") == F.lit(f"2026-06-0{d}").cast("date"))
        single += map(str, P.futures_sessions(one, none).totals.collect())
    assert whole == sorted(single) and len(whole) == 5
    assert all(r.night + r.day == r.full for r in P.futures_sessions(readings, none).contracts.collect())
