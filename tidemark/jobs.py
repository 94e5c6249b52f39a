"""Batch jobs over a folder of session tapes, for spark-submit or ``python -m tidemark.jobs``.

    options --root TAPES --out OUT [--date D | --backfill] [--window overnight|day|both] [--no-write]
    futures --root TAPES --out OUT --bars BARS [--date D | --seed | --backtest [--n N]]
            [--window overnight|eod] [--no-write]
    check   --root TAPES --date D [--eod] [--now TIMESTAMP]
    land    --root TAPES --out OUT
    refresh --root TAPES --out OUT --bars BARS --pulled CSV --today D [--days N]

Exit codes: 0 done (also on a closed date), 1 nothing to process, a missing source or an unreadable session,
2 incomplete capture, 3 usage or configuration error.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.sessions import is_holiday
from tidemark.operators.coverage import capture_check
from tidemark.operators.sizing import scope
from tidemark.plans import futures as fut
from tidemark.plans import options as opt
from tidemark.settings import COTTON, US_EXCHANGE, Market
from tidemark.sources import market as src
from tidemark.sources import landed, sinks
from tidemark.sources.delimited import quarantine

SESSION_KEYS = ("date", "commodity")
CONTRACT_KEYS = ("date", "commodity", "generic_code")


def _show(report: DataFrame, dates: list[str]) -> None:
    """Print the lines of a few named sessions (a report has some forty lines)."""
    wanted = report.filter(F.col("session_date").isin([F.lit(d).cast("date") for d in dates]))
    for row in wanted.orderBy("session_date", "section", "ord").collect():
        print(row.line)


def _history(spark: SparkSession, out: str, name: str, schema: str, keys) -> sinks.HistoryTable:
    return sinks.HistoryTable(spark, f"{out}/history/{name}", schema, keys)


def market_of(commodity: str) -> Market:
    """The default market for cotton; other codes keep its months with their own prefix. Years not listed go by the rules."""
    code = commodity.upper()
    if code == COTTON.prefix:
        return replace(COTTON, holiday_rules=US_EXCHANGE)
    return Market(prefix=code, excluded_prefixes=(), excluded_generics=(f"{code}OCT", f"{code}AUG"), serial_parents=(), holiday_rules=US_EXCHANGE)


def _closed(spark: SparkSession, session: str, market: Market) -> bool:
    return spark.range(1).select(is_holiday(F.lit(session).cast("date"), market)).first()[0]


def run_options(spark: SparkSession, root: str, out: str | None, *, commodity: str = "CT", session: str | None = None,
                window: str = "both", write: bool = True, backfill: bool = False) -> int:
    market = market_of(commodity)
    tape_name = f"{commodity.lower()}_options_tape.csv"
    try:
        if session is None and not backfill:
            last = src.session_files(spark, root, tape_name).agg(F.max("session_date").alias("d")).first().d
            session = last.isoformat()
        if session and _closed(spark, session, market):
            print(f"{commodity} closed on {session} -- no session")
            return 0
        tape = src.read_tape(spark, root, market, *([] if backfill else [session]))
        listed = src.session_files(spark, root, tape_name) if backfill else None
    except FileNotFoundError as exc:
        print(f"FATAL: {exc}", file=sys.stderr)
        return 1
    windows = ("overnight", "day") if window == "both" else (window,)
    table = _history(spark, out, "session_volume", opt.HISTORY_SCHEMA, SESSION_KEYS) if out else None
    run = opt.options_sessions(tape, table.rows() if table else None, commodity=commodity, windows=windows,
                               accumulate=write, settle=True, market=market, listed=listed)
    code = 0
    if session is not None:
        _show(run.report, [session])
    else:
        run.status.orderBy("session_date").show(truncate=False)
        code = run.status.agg(F.max("code")).first()[0] or 0
    if write and out:
        sinks.write_report(run.report, f"{out}/session_volume_report")
        sinks.write_payload(opt.document(run), f"{out}/session_volume")
        sinks.write_payload(opt.payload(run), f"{out}/session_volume_windows")
        _history(spark, out, "session_volume_by_contract", CONTRACT_HISTORY_SCHEMA,
                 ("date", "window", "generic_code")).upsert(
            opt.contract_history(run).withColumnRenamed("session_date", "date"))
        table.upsert(run.history)
    return code


CONTRACT_HISTORY_SCHEMA = ("date date, generic_code string, ice_code string, month_code string, month_name string, "
                           "delivery_year int, window string, total double, call double, put double")


def _write_futures(spark: SparkSession, out: str, run: fut.FuturesRun) -> None:
    sinks.write_report(run.report, f"{out}/futures_session_volume_report")
    sinks.write_payload(fut.document(run), f"{out}/futures_session_volume")
    _history(spark, out, "futures_session_volume", fut.HISTORY_SCHEMA, SESSION_KEYS).upsert(run.history)
    _history(spark, out, "futures_session_volume_by_contract", fut.CONTRACT_SCHEMA, CONTRACT_KEYS).upsert(
        run.contract_history)


def run_futures(spark: SparkSession, root: str, out: str | None, bars_path: str, *, commodity: str = "CT",
                session: str | None = None, window: str = "eod", write: bool = True, seed: bool = False,
                backtest: int | None = None) -> int:
    market = market_of(commodity)
    try:
        bars = src.clean_bars(src.read_bars(spark, bars_path, market), market)
    except FileNotFoundError as exc:
        print(f"FATAL: {exc}", file=sys.stderr)
        return 1
    if seed:
        rows, contracts = fut.seed_ingest(bars, commodity, market=market)
        if write and out:
            _history(spark, out, "futures_session_volume", fut.HISTORY_SCHEMA, SESSION_KEYS).upsert(rows)
            _history(spark, out, "futures_session_volume_by_contract", fut.CONTRACT_SCHEMA, CONTRACT_KEYS).upsert(contracts)
        return 0
    if not backtest and session is not None and _closed(spark, session, market):
        print(f"{commodity} closed on {session} -- no session")
        return 0
    readings = src.read_sidecar(spark, root, market, *([] if backtest else [session]))
    table = _history(spark, out, "futures_session_volume", fut.HISTORY_SCHEMA, SESSION_KEYS) if out else None
    history = table.rows() if table else None
    common = dict(commodity=commodity, market=market, settle=True, accumulate=False)
    if backtest:
        run = fut.backtest(readings, bars, backtest, history=history, **common)
        days = [r.session_date.isoformat() for r in run.sessions.collect()]
        if not days:
            return 1
    else:
        days = [session]
        run = fut.futures_sessions(readings, bars, history, dates=days, window=window, write=write, **common)
    _show(run.report, days)
    if run.writable and out:
        _write_futures(spark, out, run)
    return 0


def run_check(spark: SparkSession, root: str, session: str, *, commodity: str = "CT", eod: bool = False,
              now: str | None = None) -> int:
    market = market_of(commodity)
    calendar = spark.range(1).select(F.lit(session).cast("date").alias("session_date"))
    readings = src.read_sidecar(spark, root, market, session)
    try:
        files = src.session_files(spark, root, f"{commodity.lower()}_futures_volume.csv")
    except FileNotFoundError:
        files = None
    clock = F.lit(now or datetime.now().isoformat(sep=" ", timespec="seconds")).cast("timestamp_ntz")
    row = capture_check(calendar, readings, clock, market, eod, files).first()
    print(f"CAPTURE CHECK -- {commodity} -- {session}: {row.status}"
          + (f", due {row.due}" if row.due else "") + (f", missing {row.missing}" if row.missing else ""))
    return row.code


def run_land(spark: SparkSession, root: str, out: str, commodity: str = "CT") -> int:
    """Store the CSV tapes as Parquet by session, with rejected lines kept next to them."""
    tape = src.read_tape(spark, root, market_of(commodity))
    landed.land(tape, f"{out}/tape")
    quarantine(tape).write.mode("overwrite").json(f"{out}/tape_rejected")
    return 0


def run_refresh(spark: SparkSession, root: str, out: str, bars_path: str, pulled_path: str, today: str,
                days: int = 15, commodity: str = "CT") -> int:
    """Merge the re-pulled trailing days into the bars table, then redo the previous session.

    The table keeps every bar column, and a re-pulled row replaces the stored one also where it is
    blank; blanks are skipped when the bars are read as a seed.
    """
    market = market_of(commodity)
    table = sinks.HistoryTable(spark, f"{out}/bars", src.BARS_SCHEMA, ("session_date", "generic"), date="session_date")
    if table.rows().isEmpty():
        table.upsert(src.last_bars(src.read_bars(spark, bars_path, market)))
    pulled = src.last_bars(src.read_bars(spark, pulled_path, market))
    first = date.fromisoformat(today) - timedelta(days=days)
    table.upsert(pulled.filter((F.col("session_date") >= F.lit(first)) & (F.col("session_date") <= F.lit(today).cast("date"))))
    previous = (date.fromisoformat(today) - timedelta(days=1)).isoformat()
    run = fut.futures_sessions(src.read_sidecar(spark, root, market, previous), src.clean_bars(table.rows(), market), commodity=commodity,
                               dates=[previous], accumulate=False, settle=True, market=market)
    _write_futures(spark, out, run)
    return 0


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tidemark.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    for name in ("options", "futures", "check", "land", "refresh"):
        p = sub.add_parser(name)
        p.add_argument("--commodity", default="CT")
        p.add_argument("--root", required=True)
        if name != "check":
            p.add_argument("--out")
            p.add_argument("--no-write", action="store_true")
        if name in ("options", "futures", "check"):
            p.add_argument("--date")
        if name in ("futures", "refresh"):
            p.add_argument("--bars", required=True)
        if name == "options":
            p.add_argument("--window", choices=["overnight", "day", "both"], default="both")
            p.add_argument("--backfill", action="store_true")
        if name == "futures":
            p.add_argument("--window", choices=["overnight", "eod"], default="eod")
            p.add_argument("--seed", action="store_true")
            p.add_argument("--backtest", action="store_true")
            p.add_argument("--n", type=int, default=5)
        if name == "check":
            p.add_argument("--eod", action="store_true")
            p.add_argument("--now")
        if name == "refresh":
            p.add_argument("--pulled", required=True)
            p.add_argument("--today", required=True)
            p.add_argument("--days", type=int, default=15)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"tidemark-{a.job}").getOrCreate()
    today = datetime.now().strftime("%Y-%m-%d")
    with scope(spark):  # what the job settles on its way goes when it ends
        if a.job == "options":
            return run_options(spark, a.root, a.out, commodity=a.commodity, session=a.date, window=a.window,
                               write=not a.no_write, backfill=a.backfill)
        if a.job == "futures":
            return run_futures(spark, a.root, a.out, a.bars, commodity=a.commodity, session=a.date or today,
                               window=a.window, write=not a.no_write, seed=a.seed, backtest=a.n if a.backtest else None)
        if a.job == "check":
            return run_check(spark, a.root, a.date or today, commodity=a.commodity, eod=a.eod, now=a.now)
        if a.job == "land":
            return run_land(spark, a.root, a.out, a.commodity)
        return run_refresh(spark, a.root, a.out, a.bars, a.pulled, a.today, a.days, a.commodity)


if __name__ == "__main__":
    sys.exit(main())
