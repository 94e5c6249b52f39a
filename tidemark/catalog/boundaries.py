"""Queries over boundary readings: windows, precedence, futures sessions, capture checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import (BARS_SQL, SIDECAR_CODES, SIDECAR_SQL, TIER_COLUMNS_SQL, _session_of, pick,
                                       rounded, sidecar, table, tiers_sql)
from tidemark.catalog.bars import seed
from tidemark.catalog.registry import query
from tidemark.operators import boundary as B
from tidemark.operators import coverage as C
from tidemark.operators.ranking import rank_contracts
from tidemark.plans import futures as P

AT = "2024-02-01 00:00:00"


def run(spark, sf, **kw):
    return P.futures_sessions(sidecar(spark, sf), seed(spark, sf), generated_at=AT, **kw)


_BOTH = f"""{BARS_SQL}, {SIDECAR_SQL},
fslots AS (
  SELECT session_date, generic_code, night, day, full_volume, 'live' AS source FROM live
  UNION ALL SELECT session_date, generic, NULL, NULL, volume, 'seed' FROM seed
  WHERE session_date NOT IN (SELECT session_date FROM live)),
ftotals AS (
  SELECT session_date, source, SUM(night) AS night, SUM(day) AS day, SUM(full_volume) AS full_volume,
         COUNT(*) AS n_contracts FROM fslots GROUP BY 1, 2)"""

_NAMES = """'CT' || n.letter || CAST(dyear % 10 AS VARCHAR) AS ice_code, n.letter AS month_code, n.mname AS month_name,
  dyear AS delivery_year, n.pos AS position"""
_DYEAR = """CAST(year(f.session_date) + CASE WHEN make_date(year(f.session_date), n.mnum, 1) >= f.session_date THEN 0 ELSE 1 END
  + n.pos - 1 AS INTEGER)"""


@query("boundary_pivot", f"WITH {SIDECAR_SQL} SELECT session_date, contract, v_open, v_mid, v_end FROM piv")
def boundary_pivot(spark, sf):
    return B.pivot_boundaries(sidecar(spark, sf))


@query("boundary_windows", f"""WITH {SIDECAR_SQL} SELECT session_date, generic_code, night, day, full_volume AS "full" FROM live""")
def boundary_windows(spark, sf):
    return B.boundary_windows(sidecar(spark, sf))


@query("boundary_presence", f"""WITH {SIDECAR_SQL} SELECT session_date, boundary,
  bool_or(contract IN ('CTH4','CTK4','CTN4','CTZ4','CTZ5')) AS present FROM readings GROUP BY 1, 2""")
def boundary_presence(spark, sf):
    return C.boundary_presence(sidecar(spark, sf))


@query("futures_session_totals", f"""WITH {_BOTH} SELECT session_date, source, night, day, full_volume AS "full", n_contracts,
  ROUND(night / NULLIF(full_volume, 0), 6) AS night_share, ROUND(night / NULLIF(day, 0), 6) AS night_day_ratio FROM ftotals""")
def futures_session_totals(spark, sf):
    return rounded(run(spark, sf).totals, "night_share", "night_day_ratio")


@query("futures_session_history", f"""WITH {_BOTH} SELECT session_date AS date, 'CT' AS commodity, night AS night_total,
  day AS day_total, full_volume AS full_total, ROUND(night / NULLIF(full_volume, 0), 6) AS night_share,
  ROUND(night / NULLIF(day, 0), 6) AS night_day_ratio, source, '' AS split_source FROM ftotals""")
def futures_session_history(spark, sf):
    return rounded(run(spark, sf).history.drop("generated_at"), "night_share", "night_day_ratio")


@query("futures_contract_history", f"""WITH {_BOTH}, x AS (SELECT f.*, n.letter, n.mname, n.pos, {_DYEAR} AS dyear
  FROM fslots f JOIN named n ON n.generic = f.generic_code)
SELECT session_date AS date, 'CT' AS commodity, generic_code, 'CT' || letter || CAST(dyear % 10 AS VARCHAR) AS ice_code,
  letter AS month_code, mname AS month_name, dyear AS delivery_year, pos AS position, night, day, full_volume AS "full" FROM x""")
def futures_contract_history(spark, sf):
    return run(spark, sf).contract_history.drop("generated_at")


# night and day against earlier live sessions, full against earlier bar dates
_FRVOL = f"""WITH {_BOTH}, cur AS (
  SELECT session_date, 'night' AS metric, night AS value FROM ftotals UNION ALL SELECT session_date, 'day', day FROM ftotals
  UNION ALL SELECT session_date, 'full', full_volume FROM ftotals),
prior AS (SELECT session_date, metric, value FROM cur WHERE metric <> 'full' AND value IS NOT NULL
  UNION ALL SELECT session_date, 'full', full_volume FROM seed_total),
ord AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY session_date) AS k FROM prior),
pos AS (SELECT c.*, (SELECT COUNT(*) FROM prior p WHERE p.metric = c.metric AND p.session_date < c.session_date) AS k FROM cur c),
tiers AS (SELECT pos.session_date, pos.metric, pos.value, t.tier, AVG(o.value) AS raw_avg, COUNT(o.value) AS n,
    MAX(CASE WHEN o.k = pos.k THEN o.value END) AS prev
  FROM pos CROSS JOIN (VALUES (5), (10), (20), (30), (60)) t(tier)
  LEFT JOIN ord o ON o.metric = pos.metric AND o.k <= pos.k AND o.k > pos.k - t.tier GROUP BY 1, 2, 3, 4),
done AS (SELECT *, CASE WHEN value IS NOT NULL THEN raw_avg END AS avg_volume,
  value / NULLIF(CASE WHEN value IS NOT NULL THEN raw_avg END, 0) AS rvol FROM tiers)"""


@query("futures_rvol", f"""{_FRVOL} SELECT session_date, metric, value, tier, ROUND(avg_volume, 6) AS avg, ROUND(rvol, 6) AS rvol, n,
  CASE WHEN n < tier OR value IS NULL THEN 'n/a (have ' || n || ' of ' || tier || ')' END AS note,
  CASE WHEN rvol >= 2.0 THEN 'HIGH' WHEN rvol <= 0.5 THEN 'LOW' END AS flag, prev FROM done""")
def futures_rvol(spark, sf):
    return rounded(run(spark, sf).rvol.drop("available"), "avg", "rvol")


@query("futures_backtest", f"""{_FRVOL}, last5 AS (SELECT session_date FROM seed_total ORDER BY session_date DESC LIMIT 5)
SELECT metric, session_date, value AS volume, tier, ROUND(avg_volume, 6) AS avg, ROUND(rvol, 6) AS rvol FROM done
WHERE session_date IN (SELECT session_date FROM last5)""")
def futures_backtest(spark, sf):
    """Dry run over the last five bar sessions."""
    out = P.backtest(sidecar(spark, sf), seed(spark, sf), 5, generated_at=AT).rvol
    return rounded(out.select("metric", "session_date", F.col("value").alias("volume"), "tier", "avg", "rvol"), "avg", "rvol")


@query("futures_contract_rank", f"""WITH {_BOTH} SELECT session_date, generic_code, night, day, full_volume AS "full", source,
  ROW_NUMBER() OVER (PARTITION BY session_date ORDER BY full_volume DESC, generic_code) AS rank FROM fslots WHERE full_volume > 0""")
def futures_contract_rank(spark, sf):
    return rank_contracts(run(spark, sf).slots, ["session_date"], "full")


@query("settled_bars_preferred", f"""WITH {BARS_SQL}, {SIDECAR_SQL}, s2 AS (
  SELECT session_date + INTERVAL '8766' DAY AS d, generic, volume FROM seed),
pick AS (SELECT CAST(d AS DATE) AS session_date, generic AS generic_code, CAST(NULL AS DOUBLE) AS night, CAST(NULL AS DOUBLE) AS day,
    volume AS full_volume, 'seed' AS source FROM s2
  UNION ALL SELECT session_date, generic_code, night, day, full_volume, 'live' FROM live
  WHERE session_date NOT IN (SELECT CAST(d AS DATE) FROM s2))
SELECT session_date, source, SUM(night) AS night, SUM(day) AS day, SUM(full_volume) AS "full", COUNT(*) AS n_contracts
FROM pick GROUP BY 1, 2""")
def settled_bars_preferred(spark, sf):
    """Settled bars replace provisional live rows; the bars are moved 8766 days so that dates overlap."""
    moved = seed(spark, sf).withColumn("session_date", F.date_add("session_date", 8766))
    out = P.futures_sessions(sidecar(spark, sf), moved, prefer_seed=True, generated_at=AT).totals
    return out.drop("night_share", "night_day_ratio")


_TILT = f"""WITH {_BOTH}, shares AS (
  SELECT session_date, 'night_share' AS metric, night / NULLIF(full_volume, 0) AS value FROM ftotals
  UNION ALL SELECT session_date, 'night_day_ratio', night / NULLIF(day, 0) FROM ftotals),
{tiers_sql('shares', 'metric', 'session_date', 'value')}"""


@query("tilt_rvol", f"""{_TILT} SELECT metric, session_date, ROUND(value, 6) AS value, {TIER_COLUMNS_SQL} FROM tiers""")
def tilt_rvol(spark, sf):
    out = P.tilt_rvol(run(spark, sf).totals)
    return rounded(out.select("metric", "session_date", "value", "tier", "avg", "rvol", "n", "note", "flag"),
                   "value", "avg", "rvol")


_CONTRACTS = f"""WITH {_BOTH}, long AS (
  SELECT session_date, generic_code, 'night' AS metric, night AS value FROM fslots
  UNION ALL SELECT session_date, generic_code, 'day', day FROM fslots
  UNION ALL SELECT session_date, generic_code, 'full', full_volume FROM fslots),
{tiers_sql('long', 'generic_code, metric', 'session_date', 'value')}"""


@query("futures_contract_rvol", f"{_CONTRACTS} SELECT generic_code, metric, session_date, value, {TIER_COLUMNS_SQL} FROM tiers")
def futures_contract_rvol(spark, sf):
    out = P.contract_rvol(run(spark, sf).contracts)
    return rounded(out.select("generic_code", "metric", "session_date", "value", "tier", "avg", "rvol", "n",
                              "note", "flag"), "avg", "rvol")


@query("counter_resets", f"""WITH {SIDECAR_SQL}, p AS (SELECT session_date, contract, v_open AS open_volume,
  LAG(v_end) OVER (PARTITION BY contract ORDER BY session_date) AS prev_close FROM piv)
SELECT *, CASE WHEN open_volume IS NULL OR prev_close IS NULL THEN NULL WHEN open_volume < prev_close * 0.98 THEN 'reset'
  ELSE 'carried' END AS state FROM p""")
def counter_resets(spark, sf):
    return B.counter_resets(sidecar(spark, sf), tolerance=0.98)


# ---------------------------------------------------------------- boundary capture from polls

def as_polls(events):
    """One poll per event. The event number is the cumulative counter; errors carry no values."""
    good = F.col("event_type") != "error"
    return events.select(
        _session_of().alias("session_date"), F.col("ts").alias("snap_ts"),
        pick(F.col("user_id") % 8, *SIDECAR_CODES).alias("contract"),
        F.when(good, F.col("event_id").cast("double")).alias("volume"), F.when(good, F.col("value")).alias("oi"))


def polls(spark, sf):
    return as_polls(table(spark, sf, "events"))


POLLS_SQL = """
polls AS (SELECT CAST(ts + INTERVAL '3' HOUR AS DATE) AS session_date, ts AS snap_ts,
   CASE user_id % 8 WHEN 0 THEN 'CTH4' WHEN 1 THEN 'CTK4' WHEN 2 THEN 'CTN4' WHEN 3 THEN 'CTZ4'
        WHEN 4 THEN 'CTZ5' WHEN 5 THEN 'CTDEC2' WHEN 6 THEN 'CTV4' ELSE 'CTMAR2' END AS contract,
   CASE WHEN event_type <> 'error' THEN CAST(event_id AS DOUBLE) END AS volume,
   CASE WHEN event_type <> 'error' THEN value END AS oi FROM events),
bt(boundary, off) AS (VALUES ('open', -180), ('0700', 420), ('1420', 860)),
captured AS (SELECT * FROM (
  SELECT p.session_date, p.contract, b.boundary, p.snap_ts AS "timestamp", p.volume, p.oi,
    ROW_NUMBER() OVER (PARTITION BY p.session_date, p.contract, b.boundary ORDER BY p.snap_ts) AS rn
  FROM polls p CROSS JOIN bt b WHERE p.oi IS NOT NULL
    AND p.snap_ts >= CAST(p.session_date AS TIMESTAMP) + b.off * INTERVAL '1' MINUTE) c WHERE rn = 1)"""


@query("boundary_capture", f"""WITH {POLLS_SQL} SELECT session_date, contract, boundary, "timestamp", volume, oi FROM captured""")
def boundary_capture(spark, sf):
    return B.capture_boundaries(polls(spark, sf))


# ---------------------------------------------------------------- completeness

_CHECK = f"""WITH {SIDECAR_SQL}, cal AS (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-06', INTERVAL '1' DAY)) AS DATE)
    AS session_date),
pres AS (SELECT session_date, boundary, bool_or(contract IN ('CTH4','CTK4','CTN4','CTZ4','CTZ5')) AS present FROM readings GROUP BY 1, 2),
st AS (SELECT c.session_date, isodow(c.session_date) > 5 AS closed,
    c.session_date <= DATE '2024-01-30' AS d_open,
    c.session_date < DATE '2024-01-30' OR c.session_date = DATE '2024-01-30' AS d_mid,
    c.session_date < DATE '2024-01-30' AS d_end,
    EXISTS (SELECT 1 FROM readings r WHERE r.session_date = c.session_date) AS has_file,
    COALESCE((SELECT bool_or(present) FROM pres p WHERE p.session_date = c.session_date AND boundary = 'open'), FALSE) AS p_open,
    COALESCE((SELECT bool_or(present) FROM pres p WHERE p.session_date = c.session_date AND boundary = '0700'), FALSE) AS p_mid,
    COALESCE((SELECT bool_or(present) FROM pres p WHERE p.session_date = c.session_date AND boundary = '1420'), FALSE) AS p_end FROM cal c),
s2 AS (SELECT *, concat_ws(',', CASE WHEN d_open THEN 'open' END, CASE WHEN d_mid THEN '0700' END, CASE WHEN d_end THEN '1420' END) AS due,
    concat_ws(',', CASE WHEN d_open AND NOT p_open THEN 'open' END, CASE WHEN d_mid AND NOT p_mid THEN '0700' END,
      CASE WHEN d_end AND NOT p_end THEN '1420' END) AS missing FROM st),
s3 AS (SELECT *, CASE WHEN closed THEN 'closed' WHEN due = '' THEN 'not due' WHEN NOT has_file THEN 'file missing'
    WHEN missing <> '' THEN 'boundary missing' ELSE 'ok' END AS status FROM s2)
SELECT session_date, status, CASE WHEN status IN ('file missing','boundary missing') THEN 2 ELSE 0 END AS code,
  CASE WHEN status IN ('closed','not due') THEN '' ELSE due END AS due,
  CASE WHEN status IN ('file missing','boundary missing') THEN missing ELSE '' END AS missing FROM s3"""


@query("capture_check", _CHECK)
def capture_check(spark, sf):
    """Status of every calendar day around January 2024, as seen on 30 January at 14:21."""
    readings = sidecar(spark, sf)
    days = F.sequence(F.lit("2023-12-28").cast("date"), F.lit("2024-02-06").cast("date"))
    calendar = spark.range(1).select(F.explode(days).alias("session_date"))
    return C.capture_check(calendar, readings, F.lit("2024-01-30 14:21:00").cast("timestamp_ntz"))


def _n(c):
    return f"CASE WHEN {c} IS NULL THEN 'n/a' ELSE format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT)) END"


_SEC = "CASE metric WHEN 'night' THEN 1 WHEN 'day' THEN 2 ELSE 3 END"
_FLAG = "CASE WHEN rvol >= 2.0 THEN '  *** HIGH (>=2x)' WHEN rvol <= 0.5 THEN '  *** LOW (<=0.5x)' ELSE '' END"


def _three(c):
    return f"CASE WHEN {c} IS NULL THEN 'n/a' ELSE printf('%.3f', round_even({c}, 3)) END"


@query("futures_report", f"""{_FRVOL}, x AS (SELECT f.*, n.letter, {_DYEAR} AS dyear,
    ROW_NUMBER() OVER (PARTITION BY session_date ORDER BY full_volume DESC, generic_code) AS rk
  FROM fslots f JOIN named n ON n.generic = f.generic_code WHERE full_volume > 0),
lines AS (
  SELECT session_date, 0 AS section, 0 AS ord, 'FUTURES SESSION VOLUME -- CT -- ' || CAST(session_date AS VARCHAR) ||
    ' -- EOD (sidecar -- same-day final after 14:20 close)' AS line FROM ftotals
  UNION ALL SELECT session_date, 0, 1, repeat('=', 64) FROM ftotals
  UNION ALL SELECT session_date, 0, 2, '  Source: ' || CASE source WHEN 'live' THEN 'Sidecar (live boundary readings)'
    ELSE 'Seed bars (historical full only)' END FROM ftotals
  UNION ALL SELECT session_date, {_SEC}, 0, '' FROM cur
  UNION ALL SELECT session_date, {_SEC}, 1, CASE metric WHEN 'night' THEN 'NIGHT (open 21:00 -> 07:00 ET)'
    WHEN 'day' THEN 'DAY (07:00 -> 14:20 ET)' ELSE 'FULL (open 21:00 -> 14:20 ET)' END FROM cur
  UNION ALL SELECT session_date, {_SEC}, 2, repeat('-', 44) FROM cur
  UNION ALL SELECT session_date, {_SEC}, 3, CASE WHEN value IS NULL THEN '  n/a (historical seed -- night/day not available)'
    ELSE '  Total : ' || {_n('value')} END FROM cur
  UNION ALL SELECT session_date, {_SEC}, 5, '' FROM cur WHERE value IS NOT NULL
  UNION ALL SELECT session_date, {_SEC}, 4, '  vs prev session: ' || {_n('prev')} || CASE WHEN prev = 0 THEN '' ELSE '   ' ||
    CASE WHEN value / prev - 1 >= 0 THEN 'UP' ELSE 'DOWN' END || ' ' || CASE WHEN value / prev - 1 < 0 THEN '-' ELSE '+' END ||
    printf('%.0f', abs(round_even((value / prev - 1) * 100, 0))) || '%' END FROM done
    WHERE tier = 5 AND prev IS NOT NULL AND value IS NOT NULL
  UNION ALL SELECT session_date, {_SEC}, 100 + tier, '  RVOL-' || lpad(CAST(tier AS VARCHAR), 2, ' ') || '  ' ||
    CASE WHEN avg_volume IS NULL THEN 'n/a (have ' || n || ' of ' || tier || ')' ELSE 'avg=' || lpad({_n('avg_volume')}, 9, ' ') ||
      '  rvol=' || COALESCE(printf('%.2f', round_even(rvol, 2)) || 'x', 'n/a') || {_FLAG} ||
      CASE WHEN n < tier THEN '  [n/a (have ' || n || ' of ' || tier || ')]' ELSE '' END END FROM done WHERE value IS NOT NULL
  UNION ALL SELECT session_date, 4, u.ord, u.line FROM (SELECT session_date, unnest([{{'ord': 0, 'line': ''}},
    {{'ord': 1, 'line': 'NIGHT vs DAY tilt'}}, {{'ord': 2, 'line': repeat('-', 44)}},
    {{'ord': 3, 'line': '  night_share (night/full)   : ' || {_three('night / NULLIF(full_volume, 0)')}}},
    {{'ord': 4, 'line': '  night_day_ratio (night/day): ' || {_three('night / NULLIF(day, 0)')}}},
    {{'ord': 5, 'line': ''}}, {{'ord': 6, 'line': 'By contract (full | night | day):'}},
    {{'ord': 7, 'line': CASE WHEN COALESCE(full_volume, 0) <= 0 THEN '  (no volume recorded)' END}}]) AS u FROM ftotals) y
    WHERE u.line IS NOT NULL
  UNION ALL SELECT session_date, 4, 7 + rk, '  ' || rpad(generic_code, 8, ' ') || ' (CT' || letter || CAST(dyear % 10 AS VARCHAR) ||
    '/' || dyear || ')  ' || lpad({_n('full_volume')}, 9, ' ') || '  |  ' || lpad({_n('night')}, 8, ' ') || '  |  ' ||
    lpad({_n('day')}, 8, ' ') FROM x
  UNION ALL SELECT session_date, 9, 0, '' FROM ftotals
  UNION ALL SELECT session_date, 9, 1, 'Generated: 2024-02-01T00:00:00' FROM ftotals)
SELECT session_date, section, ord, line FROM lines""")
def futures_report(spark, sf):
    return run(spark, sf, settle=True).report.withColumn("ord", F.col("ord").cast("bigint"))


@query("refreshed_previous_session", f"""WITH {BARS_SQL}, d AS (SELECT MAX(session_date) AS last_date FROM seed),
merged AS (SELECT session_date, generic, CASE WHEN session_date > (SELECT last_date FROM d) - INTERVAL '15' DAY
  THEN volume + 1 ELSE volume END AS volume FROM seed)
SELECT session_date, 'seed' AS source, CAST(NULL AS DOUBLE) AS night, CAST(NULL AS DOUBLE) AS day, SUM(volume) AS "full",
  COUNT(*) AS n_contracts FROM merged WHERE session_date = (SELECT last_date FROM d) GROUP BY 1""")
def refreshed_previous_session(spark, sf):
    """Trailing refresh run on the day after the last bar date: that session is recomputed."""
    daily = seed(spark, sf)
    as_of = F.date_add(daily.select(F.max("session_date")).scalar(), 1)
    pulled = daily.withColumn("volume", F.col("volume") + 1)
    merged, out = P.refresh(sidecar(spark, sf), daily, pulled, as_of, 15, generated_at=AT)
    return out.totals.drop("night_share", "night_day_ratio")
