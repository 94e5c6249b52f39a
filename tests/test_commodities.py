"""Two commodities in one plan give what each gives alone, in every result."""

import pytest
from builders import write_csv
from pyspark.sql import functions as F

from tidemark.catalog import commodities as C
from tidemark.catalog.adapters import sidecar, tape
from tidemark.catalog.bars import seed
from tidemark.plans import futures as fut
from tidemark.plans import options as P
from tidemark.settings import COTTON, Market, listed
from tidemark.sources.market import read_sidecar, read_tape

SF, AT = "/root/testdata/sf0.001", "2024-02-01 00:00:00"


def lines(df):
    return sorted(str(r) for r in df.select(sorted(df.columns)).collect())


def compare(both, alone, *names):
    """``alone``: prefix -> run. Results named by function or attribute."""
    for name in names:
        of = name if callable(name) else lambda run, n=name: getattr(run, n)
        whole = of(both)
        assert "commodity" in whole.columns, name
        for prefix, run in alone.items():
            part, one = whole.filter(F.col("commodity") == prefix), of(run)
            if "commodity" not in one.columns:
                part = part.drop("commodity")
            assert lines(part) == lines(one) != [], (prefix, name)


RESULTS = {True: ("totals", "rvol", "history", "report", "status", P.contract_history, P.payload, P.document), False: ("rvol",)}


@pytest.mark.parametrize("accumulate", RESULTS)
def test_options(spark, accumulate):
    rows = C._both(tape(spark, SF), "contract", "call_vol", "put_vol").coalesce(2).cache()
    history = P.options_sessions(rows.filter("day(session_date) < 9"), generated_at=AT, market=C.BOTH).history.cache()
    how = dict(generated_at=AT, accumulate=accumulate, history=history, settle=True)
    both = P.options_sessions(rows, market=C.BOTH, listed=rows.select("commodity", "session_date").distinct(), **how)
    alone = {}
    for m in C.BOTH:
        own = rows.filter(F.col("commodity") == m.prefix).drop("commodity")
        alone[m.prefix] = P.options_sessions(own, market=m, commodity=m.prefix, listed=own.select("session_date").distinct(), **how)
    compare(both, alone, *RESULTS[accumulate])


def test_futures(spark):
    readings, bars = (df.coalesce(2).cache() for df in (C._both(sidecar(spark, SF), "contract", "volume"), C._both(seed(spark, SF), "generic", "volume")))
    both = fut.futures_sessions(readings, bars, generated_at=AT, market=C.BOTH, settle=True)
    alone = {m.prefix: fut.futures_sessions(readings.filter(F.col("commodity") == m.prefix), bars.filter(F.col("commodity") == m.prefix),
                                            commodity=m.prefix, generated_at=AT, market=m, settle=True) for m in C.BOTH}
    compare(both, alone, "totals", "rvol", "history", "contract_history", "report", fut.document, lambda r: fut.tilt_rvol(r.totals),
            lambda r: fut.contract_rvol(r.contracts))


def test_dates_are_reported_for_each_market(spark):
    run = fut.futures_sessions(C._both(sidecar(spark, SF), "contract", "volume"), C._both(seed(spark, SF), "generic", "volume"),
                               dates=["2024-01-17"], generated_at=AT, market=C.BOTH)
    assert sorted((r.commodity, str(r.session_date)) for r in run.sessions.collect()) == [("CT", "2024-01-17"), ("SB", "2024-01-17")]


def test_files_of_several_commodities(spark, tmp_path):
    for code, n in (("ct", 2), ("sb", 3), ("kc", 9)):
        write_csv(tmp_path / "2026-06-17" / f"{code}_options_tape.csv", ["timestamp", "contract", "strike", "call_vol", "put_vol"],
                  [["2026-06-17 02:00:00", f"{code.upper()}Z6", 60, n, 1]])
        write_csv(tmp_path / "2026-06-17" / f"{code}_futures_volume.csv", ["timestamp", "date", "commodity", "contract", "boundary", "volume", "oi"],
                  [["t", "2026-06-17", code, f"{code.upper()}Z6", "open", n, ""]])
    rows = read_tape(spark, str(tmp_path), C.BOTH)
    assert sorted((r.commodity, r.call_vol) for r in rows.collect()) == [("CT", 2.0), ("SB", 3.0)]
    run = P.options_sessions(rows, market=C.BOTH, generated_at=AT)
    assert sorted((r.commodity, r.window, r.total) for r in run.totals.collect()) == [("CT", "overnight", 3.0), ("SB", "overnight", 4.0)]
    assert sorted(r.commodity for r in read_sidecar(spark, str(tmp_path), C.BOTH).collect()) == ["CT", "SB"]
    assert "commodity" not in read_tape(spark, str(tmp_path)).columns


def test_markets_of_one_plan_share_their_windows():
    with pytest.raises(ValueError):
        listed((COTTON, Market(prefix="SB", day_end=(13, 0))))
    with pytest.raises(ValueError):
        listed((COTTON, COTTON))
    assert listed(COTTON) == (COTTON,)
