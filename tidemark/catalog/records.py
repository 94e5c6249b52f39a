"""Readers, policies and rules that the other queries do not reach, each over derived files or rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import options as opt
from tidemark.catalog.adapters import BARS_SQL, SIDECAR_SQL, TAPE_SQL, bars, sidecar, tape
from tidemark.catalog.bars import seed
from tidemark.catalog.registry import SQL, query
from tidemark.functions.sessions import is_closed, is_holiday
from tidemark.functions.symbology import is_excluded_generic
from tidemark.operators import boundary as B
from tidemark.operators.sizing import shared_folder
from tidemark.plans import futures as fut
from tidemark.settings import SIDECAR_COLUMNS, Market
from tidemark.sources import sinks
from tidemark.sources.delimited import quarantine
from tidemark.sources.market import prior_series, read_history, read_sidecar, read_tape, session_files
from tidemark.sources.versions import read_table

_HEADER = "timestamp,contract,strike,call_vol,put_vol"


def tape_text(spark, sf):
    """Tape files as text below a new folder; every poll of a minute 13 has a cell too many."""
    root = shared_folder(spark)
    cells = F.concat_ws(",", F.date_format("snap_ts", "yyyy-MM-dd HH:mm:ss"), "contract", "strike", "call_vol", "put_vol")
    rows = tape(spark, sf).select("session_date", F.lit(1).alias("ord"), F.when(F.minute("snap_ts") == 13, F.concat(cells, F.lit(",x")))
                                  .otherwise(cells).alias("value"))
    top = rows.select("session_date").distinct().select("session_date", F.lit(0).alias("ord"), F.lit(_HEADER).alias("value"))
    # one file per session, its header first
    rows.unionByName(top).repartition("session_date").sortWithinPartitions("session_date", "ord") \
        .select("session_date", "value").write.partitionBy("session_date").text(root)
    return root


@query("rejected_tape_lines", f"""WITH {TAPE_SQL} SELECT session_date, COUNT(*) AS n, MAX(contract) AS last_contract FROM tape WHERE minute(snap_ts) = 13 GROUP BY 1""")
def rejected_tape_lines(spark, sf):
    """Lines that do not fit their header, per session."""
    found = read_tape(spark, tape_text(spark, sf), files="session_date=*/*.txt")
    lines = quarantine(found)
    session = F.regexp_extract("file_path", "session_date=([0-9-]+)", 1).cast("date")
    return lines.groupBy(session.alias("session_date")).agg(F.count("*").alias("n"), F.max("parsed.contract").alias("last_contract"))


@query("listed_sessions", f"WITH {TAPE_SQL} SELECT DISTINCT session_date FROM tape")
def listed_sessions(spark, sf):
    """Sessions that hold a tape file, from the listing alone."""
    return session_files(spark, tape_text(spark, sf), "*.txt", folder="session_date=*")


@query("boundary_windows_with_a_missing_source", SQL["boundary_windows"])
def boundary_windows_with_a_missing_source(spark, sf):
    """A source that is not there gives no rows where the caller asks for that."""
    root = shared_folder(spark)
    rows = sidecar(spark, sf).select(
        F.lit("t").alias("timestamp"), F.col("session_date").alias("date"), F.lit("CT").alias("commodity"), "contract",
        "boundary", "volume", F.lit(None).cast("double").alias("oi"), "session_date")
    rows.select(*SIDECAR_COLUMNS, "session_date").write.partitionBy("session_date").option("header", True).csv(root)
    there = read_sidecar(spark, root, files="session_date=*/*.csv")
    return B.boundary_windows(there.unionByName(read_sidecar(spark, f"{root}/none", missing="empty")))


@query("last_reading_wins", f"""WITH {SIDECAR_SQL}, many AS (
  SELECT session_date, contract, boundary, seq, CASE WHEN seq = 3 AND contract <> 'CTH4' THEN NULL ELSE volume + seq * 10 END AS volume
  FROM readings CROSS JOIN (VALUES (1), (2), (3)) s(seq))
SELECT session_date, contract, arg_max(volume, seq) FILTER (boundary = 'open' AND volume IS NOT NULL) AS v_open,
  arg_max(volume, seq) FILTER (boundary = '0700' AND volume IS NOT NULL) AS v_mid,
  arg_max(volume, seq) FILTER (boundary = '1420' AND volume IS NOT NULL) AS v_end FROM many GROUP BY 1, 2""")
def last_reading_wins(spark, sf):
    """Each reading three times in file order, the last one mostly blank: the last value counts."""
    many = sidecar(spark, sf).drop("seq").withColumn("seq", F.explode(F.array(F.lit(2), F.lit(3), F.lit(1))))
    blank = (F.col("seq") == 3) & (F.col("contract") != "CTH4")
    return B.pivot_boundaries(many.withColumn("volume", F.when(~blank, F.col("volume") + F.col("seq") * 10)))


@query("live_readings_preferred", f"""WITH {BARS_SQL}, {SIDECAR_SQL}, s2 AS (
  SELECT CAST(session_date + INTERVAL '8766' DAY AS DATE) AS session_date, generic, volume FROM seed),
pick AS (SELECT session_date, generic_code, night, day, full_volume, 'live' AS source FROM live
  UNION ALL SELECT session_date, generic, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), volume, 'seed' FROM s2
  WHERE session_date NOT IN (SELECT session_date FROM live))
SELECT session_date, source, SUM(night) AS night, SUM(day) AS day, SUM(full_volume) AS "full", COUNT(*) AS n_contracts
FROM pick GROUP BY 1, 2""")
def live_readings_preferred(spark, sf):
    """The default direction, with daily bars moved onto the sessions that have readings."""
    moved = seed(spark, sf).withColumn("session_date", F.date_add("session_date", 8766))
    return B.session_totals(B.session_slots(sidecar(spark, sf), moved)).drop("night_share", "night_day_ratio")


@query("excluded_generics", f"""WITH {BARS_SQL} SELECT generic, generic LIKE 'CTOCT%' OR generic LIKE 'CTAUG%' AS is_excluded,
  SUM(volume) AS volume FROM bars GROUP BY 1""")
def excluded_generics(spark, sf):
    totals = bars(spark, sf).groupBy("generic").agg(F.sum("volume").alias("volume"))
    return totals.select("generic", is_excluded_generic(F.col("generic")).alias("is_excluded"), "volume")


_HOLIDAYS = ("1996-07-04", "1996-12-25", "1997-01-01", "1997-07-04", "1998-05-25")


@query("closed_bar_dates", f"""WITH {BARS_SQL}, d AS (SELECT DISTINCT session_date FROM bars)
SELECT session_date, session_date IN ({", ".join(f"DATE '{d}'" for d in _HOLIDAYS)}) AS is_holiday,
  session_date IN ({", ".join(f"DATE '{d}'" for d in _HOLIDAYS)}) OR isodow(session_date) >= 6 AS is_closed FROM d""")
def closed_bar_dates(spark, sf):
    """A market with holidays of its own: the days it is closed on."""
    market = Market(closed_dates=_HOLIDAYS)
    days = bars(spark, sf).select("session_date").distinct()
    return days.select("session_date", is_holiday(F.col("session_date"), market).alias("is_holiday"),
                       is_closed(F.col("session_date"), market).alias("is_closed"))


def _stored_history(spark, sf):
    table = sinks.HistoryTable(spark, shared_folder(spark), fut.HISTORY_SCHEMA, ("date", "commodity"))
    table.upsert(fut.seed_ingest(seed(spark, sf), generated_at=opt.AT)[0])
    return table.path


@query("stored_prior_series", f"WITH {BARS_SQL} SELECT session_date, full_volume AS value FROM seed_total")
def stored_prior_series(spark, sf):
    """A history written, read back for one commodity (whatever its case) and reduced to a series."""
    return prior_series(read_history(spark, _stored_history(spark, sf), fut.HISTORY_SCHEMA, "ct"), "full_total", "Ct")


@query("replaced_bars", f"WITH {BARS_SQL} SELECT session_date, generic, volume FROM seed WHERE year(session_date) = 1996")
def replaced_bars(spark, sf):
    """A full replace leaves nothing of the table that was there."""
    root = shared_folder(spark)
    sinks.replace_table(seed(spark, sf), root)
    sinks.replace_table(seed(spark, sf).filter(F.year("session_date") == 1996), root)
    return read_table(spark, root)
