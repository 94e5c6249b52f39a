"""Market inputs derived from the generic test tables, as DataFrames and as SQL.

``events`` becomes the options tape, the polls and the boundary readings of January 2024,
``lineitem`` the daily bars of 1995-2001. The SQL texts are written separately and serve the
side-by-side check only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(key: Column, *values: str) -> Column:
    """values[key]."""
    return F.element_at(F.expr(f"array{values!r}"), (key + 1).cast("int"))


# ---------------------------------------------------------------- options tape

# Contract codes of the derived tape.
TAPE_CODES = ("CTH4", "CTH5", "CTK4", "CTK5", "CTN4", "CTN5", "CTZ4", "CTZ5",
              "CTU4", "CTX4", "CTF5", "CTV4", "CTQ4", "CTZ6", "KCZ4", "CTZ4")


def _session_of(ts: str = "ts") -> Column:
    return (F.col(ts) + F.expr("INTERVAL '3' HOUR")).cast("date")


def tape(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly polls of cumulative call and put volume per contract and strike."""
    is_call = F.col("event_type").isin("click", "view", "signup")
    inc = table(spark, sf, "events").select(
        _session_of().alias("session_date"),
        (F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.expr("INTERVAL '1' HOUR")).alias("snap_ts"),
        pick(F.col("user_id") % 16, *TAPE_CODES).alias("contract"),
        (F.col("user_id") % 3).alias("strike"), is_call.cast("int").alias("c"), (~is_call).cast("int").alias("p"),
    ).groupBy("session_date", "snap_ts", "contract", "strike").agg(F.sum("c").alias("dc"), F.sum("p").alias("dp"))
    # at most 24 hourly rows per partition
    run = Window.partitionBy("session_date", "contract", "strike").orderBy("snap_ts").rowsBetween(
        Window.unboundedPreceding, 0)
    return inc.select("session_date", "snap_ts", "contract", "strike",
                      F.sum("dc").over(run).cast("double").alias("call_vol"),
                      F.sum("dp").over(run).cast("double").alias("put_vol"))


TAPE_SQL = """
ev AS (
  SELECT CAST(ts + INTERVAL '3' HOUR AS DATE) AS session_date,
         date_trunc('hour', ts) + INTERVAL '1' HOUR AS snap_ts,
         CASE user_id % 16 WHEN 0 THEN 'CTH4' WHEN 1 THEN 'CTH5' WHEN 2 THEN 'CTK4' WHEN 3 THEN 'CTK5'
              WHEN 4 THEN 'CTN4' WHEN 5 THEN 'CTN5' WHEN 6 THEN 'CTZ4' WHEN 7 THEN 'CTZ5'
              WHEN 8 THEN 'CTU4' WHEN 9 THEN 'CTX4' WHEN 10 THEN 'CTF5' WHEN 11 THEN 'CTV4'
              WHEN 12 THEN 'CTQ4' WHEN 13 THEN 'CTZ6' WHEN 14 THEN 'KCZ4' ELSE 'CTZ4' END AS contract,
         user_id % 3 AS strike,
         CASE WHEN event_type IN ('click','view','signup') THEN 1 ELSE 0 END AS c,
         CASE WHEN event_type IN ('click','view','signup') THEN 0 ELSE 1 END AS p
  FROM events),
inc AS (SELECT session_date, snap_ts, contract, strike, SUM(c) AS dc, SUM(p) AS dp
        FROM ev GROUP BY session_date, snap_ts, contract, strike),
tape AS (SELECT session_date, snap_ts, contract, strike,
  CAST(SUM(dc) OVER (PARTITION BY session_date, contract, strike ORDER BY snap_ts) AS DOUBLE) AS call_vol,
  CAST(SUM(dp) OVER (PARTITION BY session_date, contract, strike ORDER BY snap_ts) AS DOUBLE) AS put_vol
  FROM inc),
slot_of(contract, slot) AS (VALUES ('CTZ4','CTDEC1'), ('CTU4','CTDEC1'), ('CTX4','CTDEC1'), ('CTZ5','CTDEC2'),
  ('CTH4','CTMAR1'), ('CTH5','CTMAR2'), ('CTF5','CTMAR2'), ('CTK4','CTMAY1'), ('CTK5','CTMAY2'),
  ('CTN4','CTJUL1'), ('CTN5','CTJUL2')),
marks AS (
  SELECT session_date, on_ts, CASE WHEN s_ts < e_ts THEN s_ts END AS s_ts,
         CASE WHEN s_ts < e_ts THEN e_ts END AS e_ts
  FROM (SELECT session_date,
          MAX(snap_ts) FILTER (snap_ts <= CAST(session_date AS TIMESTAMP) + INTERVAL '7' HOUR) AS on_ts,
          MAX(snap_ts) FILTER (snap_ts <= CAST(session_date AS TIMESTAMP) + INTERVAL '25259' SECOND) AS s_ts,
          MAX(snap_ts) FILTER (snap_ts <= CAST(session_date AS TIMESTAMP) + INTERVAL '51659' SECOND) AS e_ts
        FROM tape GROUP BY session_date) m),
on_slots AS (
  SELECT t.session_date, s.slot AS generic_code, SUM(call_vol) AS call, SUM(put_vol) AS put
  FROM tape t JOIN marks m ON t.session_date = m.session_date AND t.snap_ts = m.on_ts
  JOIN slot_of s ON s.contract = t.contract GROUP BY 1, 2),
s_slots AS (
  SELECT t.session_date, s.slot AS generic_code, SUM(call_vol) AS call, SUM(put_vol) AS put
  FROM tape t JOIN marks m ON t.session_date = m.session_date AND t.snap_ts = m.s_ts
  JOIN slot_of s ON s.contract = t.contract GROUP BY 1, 2),
e_slots AS (
  SELECT t.session_date, s.slot AS generic_code, SUM(call_vol) AS call, SUM(put_vol) AS put
  FROM tape t JOIN marks m ON t.session_date = m.session_date AND t.snap_ts = m.e_ts
  JOIN slot_of s ON s.contract = t.contract GROUP BY 1, 2),
day_slots AS (
  SELECT COALESCE(e.session_date, s.session_date) AS session_date,
         COALESCE(e.generic_code, s.generic_code) AS generic_code,
         GREATEST(0.0, COALESCE(e.call, 0) - COALESCE(s.call, 0)) AS call,
         GREATEST(0.0, COALESCE(e.put, 0) - COALESCE(s.put, 0)) AS put
  FROM e_slots e FULL OUTER JOIN s_slots s
    ON e.session_date = s.session_date AND e.generic_code = s.generic_code),
slots AS (
  SELECT session_date, 'overnight' AS win, generic_code, call, put, call + put AS total FROM on_slots
  UNION ALL SELECT session_date, 'day', generic_code, call, put, call + put FROM day_slots),
wmarks AS (
  SELECT session_date, 'overnight' AS win, CAST(NULL AS TIMESTAMP) AS snapshot_ts_start, on_ts AS snapshot_ts
  FROM marks WHERE on_ts IS NOT NULL
  UNION ALL SELECT session_date, 'day', s_ts, e_ts FROM marks WHERE e_ts IS NOT NULL),
totals AS (
  SELECT w.session_date, w.win, COALESCE(SUM(s.call), 0.0) AS call, COALESCE(SUM(s.put), 0.0) AS put,
         COALESCE(SUM(s.total), 0.0) AS total, w.snapshot_ts_start, w.snapshot_ts
  FROM wmarks w LEFT JOIN slots s ON w.session_date = s.session_date AND w.win = s.win
  GROUP BY w.session_date, w.win, w.snapshot_ts_start, w.snapshot_ts)"""


# ---------------------------------------------------------------- daily bars

# Slot names of the derived bars.
GENERICS = ("CTMAR1", "CTMAR2", "CTMAY1", "CTMAY2", "CTJUL1", "CTJUL2", "CTDEC1", "CTDEC2", "CTOCT1", "CTAUG1")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (session_date, generic): traded volume, open interest, prices."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_shipdate").cast("date").alias("session_date"),
        pick(F.col("l_partkey") % 10, *GENERICS).alias("generic"),
    ).agg(F.sum("l_quantity").alias("volume"), F.count("*").cast("double").alias("open_int"),
          F.max("l_extendedprice").alias("px_last"))


BARS_SQL = """
bars AS (
  SELECT CAST(l_shipdate AS DATE) AS session_date,
    CASE l_partkey % 10 WHEN 0 THEN 'CTMAR1' WHEN 1 THEN 'CTMAR2' WHEN 2 THEN 'CTMAY1' WHEN 3 THEN 'CTMAY2'
      WHEN 4 THEN 'CTJUL1' WHEN 5 THEN 'CTJUL2' WHEN 6 THEN 'CTDEC1' WHEN 7 THEN 'CTDEC2'
      WHEN 8 THEN 'CTOCT1' ELSE 'CTAUG1' END AS generic,
    SUM(l_quantity) AS volume, CAST(COUNT(*) AS DOUBLE) AS open_int, MAX(l_extendedprice) AS px_last
  FROM lineitem GROUP BY 1, 2),
seed AS (SELECT session_date, generic, volume FROM bars WHERE generic NOT LIKE 'CTOCT%' AND generic NOT LIKE 'CTAUG%'),
seed_total AS (SELECT session_date, SUM(volume) AS full_volume FROM seed GROUP BY 1),
named(generic, letter, mname, mnum, pos) AS (VALUES ('CTMAR1','H','Mar',3,1), ('CTMAR2','H','Mar',3,2),
  ('CTMAY1','K','May',5,1), ('CTMAY2','K','May',5,2), ('CTJUL1','N','Jul',7,1), ('CTJUL2','N','Jul',7,2),
  ('CTDEC1','Z','Dec',12,1), ('CTDEC2','Z','Dec',12,2)),
seed_named AS (
  SELECT s.session_date, s.generic, s.volume, n.letter, n.mname, n.pos, n.mnum,
    CAST(year(s.session_date) + CASE WHEN make_date(year(s.session_date), n.mnum, 1) >= s.session_date THEN 0 ELSE 1 END
      + n.pos - 1 AS INTEGER) AS dyear
  FROM seed s JOIN named n ON n.generic = s.generic)"""


# ---------------------------------------------------------------- boundary readings

# Codes of the derived readings, both spellings.
SIDECAR_CODES = ("CTH4", "CTK4", "CTN4", "CTZ4", "CTZ5", "CTDEC2", "CTV4", "CTMAR2")


def sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """Three cumulative readings per contract and session, exchange and slot spellings mixed.

    The 14:20 feed of CTH4 is down on Wednesdays, so partial contracts occur.
    """
    ev = table(spark, sf, "events").select(
        _session_of().alias("session_date"), "ts",
        pick(F.col("user_id") % 8, *SIDECAR_CODES).alias("contract"))
    start = F.col("session_date").cast("timestamp_ntz")
    counts = ev.groupBy("session_date", "contract").agg(*[
        F.count_if(F.col("ts") <= start + F.expr(f"INTERVAL '{m}' MINUTE")).alias(b)
        for b, m in (("open", -180), ("0700", 420), ("1420", 860))])
    b = F.explode(F.array(*[F.struct(F.lit(x).alias("boundary"), (1000 + F.col(x)).cast("double").alias("volume"))
                            for x in ("open", "0700", "1420")])).alias("b")
    down = (F.col("contract") == "CTH4") & (F.weekday("session_date") == 2) & (F.col("boundary") == "1420")
    return counts.select("session_date", "contract", b).select(
        "session_date", "contract", "b.boundary", "b.volume", F.lit(0).alias("seq")).filter(~down)


SIDECAR_SQL = """
sev AS (SELECT CAST(ts + INTERVAL '3' HOUR AS DATE) AS session_date, ts,
   CASE user_id % 8 WHEN 0 THEN 'CTH4' WHEN 1 THEN 'CTK4' WHEN 2 THEN 'CTN4' WHEN 3 THEN 'CTZ4'
        WHEN 4 THEN 'CTZ5' WHEN 5 THEN 'CTDEC2' WHEN 6 THEN 'CTV4' ELSE 'CTMAR2' END AS contract
   FROM events),
bnd(boundary, off) AS (VALUES ('open', -180), ('0700', 420), ('1420', 860)),
readings AS (
  SELECT * FROM (
    SELECT e.session_date, e.contract, b.boundary,
           CAST(1000 + SUM(CASE WHEN e.ts <= CAST(e.session_date AS TIMESTAMP) + b.off * INTERVAL '1' MINUTE
                                THEN 1 ELSE 0 END) AS DOUBLE) AS volume
    FROM sev e CROSS JOIN bnd b GROUP BY 1, 2, 3) r
  WHERE NOT (boundary = '1420' AND contract = 'CTH4' AND isodow(session_date) = 3)),
piv AS (
  SELECT session_date, contract, MAX(volume) FILTER (boundary = 'open') AS v_open,
         MAX(volume) FILTER (boundary = '0700') AS v_mid, MAX(volume) FILTER (boundary = '1420') AS v_end
  FROM readings GROUP BY 1, 2),
sslot(contract, slot, ice) AS (VALUES ('CTH4','CTMAR1',1), ('CTK4','CTMAY1',1), ('CTN4','CTJUL1',1),
  ('CTZ4','CTDEC1',1), ('CTZ5','CTDEC2',1), ('CTDEC2','CTDEC2',0), ('CTMAR2','CTMAR2',0)),
live0 AS (
  SELECT p.session_date, s.slot AS generic_code, s.ice, GREATEST(0.0, v_mid - v_open) AS night,
         GREATEST(0.0, v_end - v_mid) AS day
  FROM piv p JOIN sslot s ON s.contract = p.contract
  WHERE v_open IS NOT NULL AND v_mid IS NOT NULL AND v_end IS NOT NULL),
live AS (
  SELECT session_date, generic_code, night, day, night + day AS full_volume
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_date, generic_code ORDER BY ice DESC) AS rn
        FROM live0 WHERE night + day > 0) x WHERE rn = 1)"""


# ---------------------------------------------------------------- trailing tiers in SQL

def tiers_sql(source: str, keys: str, date: str, value: str, out: str = "tiers") -> str:
    """CTE: long tier rows of a series compared with its own earlier rows."""
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    selects = " UNION ALL ".join(
        f"SELECT {lead}{date}, {value}, {t} AS tier, "
        f"AVG({value}) OVER ({part}ORDER BY {date} ROWS BETWEEN {t} PRECEDING AND 1 PRECEDING) AS avg_volume, "
        f"COUNT({value}) OVER ({part}ORDER BY {date} ROWS BETWEEN {t} PRECEDING AND 1 PRECEDING) AS n "
        f"FROM {source} WHERE {value} IS NOT NULL" for t in (5, 10, 20, 30, 60))
    return f"""
{out} AS (
  SELECT *, {value} / NULLIF(avg_volume, 0) AS rvol FROM ({selects}) q)"""


TIER_COLUMNS_SQL = """tier, ROUND(avg_volume, 6) AS avg, ROUND(rvol, 6) AS rvol, n,
  CASE WHEN n < tier THEN 'n/a (have ' || n || ' of ' || tier || ')' END AS note,
  CASE WHEN rvol >= 2.0 THEN 'HIGH' WHEN rvol <= 0.5 THEN 'LOW' END AS flag"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round ratio columns, so that last-bit differences of two engines do not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
