"""Queries over the options tape: snapshots, windows, totals, comparison, history, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import TAPE_SQL, TIER_COLUMNS_SQL, rounded, tape, tiers_sql
from tidemark.catalog.registry import query
from tidemark.functions import symbology as S
from tidemark.functions.sessions import is_closed
from tidemark.operators import tape as T
from tidemark.operators import trailing as R
from tidemark.operators.ranking import rank_contracts, without_volume
from tidemark.operators.upsert import upsert
from tidemark.plans import history as H
from tidemark.plans import options as P

AT = "2024-02-01 00:00:00"


def run(spark, sf, **kw):
    return P.options_sessions(tape(spark, sf), generated_at=AT, **kw)


@query("tape_sessions", f"""WITH {TAPE_SQL} SELECT session_date, COUNT(DISTINCT snap_ts) AS n_snapshots,
  MIN(snap_ts) AS first_ts, MAX(snap_ts) AS last_ts FROM tape GROUP BY 1""")
def tape_sessions(spark, sf):
    return T.sessions(tape(spark, sf))


@query("tape_snapshots", f"WITH {TAPE_SQL} SELECT DISTINCT session_date, snap_ts FROM tape")
def tape_snapshots(spark, sf):
    return T.snapshots(tape(spark, sf))


@query("latest_tape_session", f"WITH {TAPE_SQL} SELECT MAX(session_date) AS session_date FROM tape")
def latest_tape_session(spark, sf):
    return T.latest_session(tape(spark, sf))


@query("snapshot_marks", f"""WITH {TAPE_SQL} SELECT session_date, on_ts AS overnight_ts, s_ts AS day_start_ts,
  e_ts AS day_end_ts FROM marks""")
def snapshot_marks(spark, sf):
    return T.marks(tape(spark, sf))


@query("option_contract_slots", f"""WITH {TAPE_SQL}, c AS (SELECT DISTINCT session_date, contract FROM tape)
SELECT c.session_date, c.contract, s.slot AS generic_code, s.slot IS NOT NULL AS in_universe,
  c.contract IN ('CTV4','CTQ4') AS excluded,
  CASE WHEN c.contract IN ('CTU4','CTX4') THEN 'CTZ' WHEN c.contract = 'CTF5' THEN 'CTH'
    WHEN substr(c.contract, 3, 1) IN ('H','K','N','Z') THEN substr(c.contract, 1, 3) END AS parent
FROM c LEFT JOIN slot_of s ON s.contract = c.contract""")
def option_contract_slots(spark, sf):
    """Mapping of every listed option contract; positions beyond the slots stay, flagged."""
    c = tape(spark, sf).select("session_date", "contract").distinct()
    code = F.col("contract")
    slot = S.option_slot(code, F.col("session_date"))
    return c.select("session_date", "contract", slot.alias("generic_code"), slot.isNotNull().alias("in_universe"),
                    S.is_excluded_code(code).alias("excluded"), S.parent_prefix(code).alias("parent"))


@query("overnight_slots", f"WITH {TAPE_SQL} SELECT session_date, generic_code, call, put, total FROM slots WHERE win = 'overnight'")
def overnight_slots(spark, sf):
    return T.window_slots(tape(spark, sf)).filter(F.col("window") == "overnight").drop("window")


@query("day_slots", f"WITH {TAPE_SQL} SELECT session_date, generic_code, call, put, total FROM slots WHERE win = 'day'")
def day_slots(spark, sf):
    return T.window_slots(tape(spark, sf)).filter(F.col("window") == "day").drop("window")


_TOTALS = """session_date, win AS "window", total, call, put, ROUND(put / NULLIF(call, 0), 6) AS pc_ratio"""


@query("option_window_totals", f"WITH {TAPE_SQL} SELECT {_TOTALS}, snapshot_ts_start, snapshot_ts FROM totals")
def option_window_totals(spark, sf):
    return rounded(run(spark, sf).totals, "pc_ratio")


@query("option_full_window", f"""WITH {TAPE_SQL} SELECT session_date, SUM(total) AS total, SUM(call) AS call, SUM(put) AS put,
  COUNT(*) AS n_windows, ROUND(SUM(put) / NULLIF(SUM(call), 0), 6) AS pc_ratio FROM totals GROUP BY 1""")
def option_full_window(spark, sf):
    return rounded(T.full_window(run(spark, sf).totals), "pc_ratio")


@query("option_rvol", f"""WITH {TAPE_SQL}, {tiers_sql('totals', 'win', 'session_date', 'total')}
SELECT session_date, win AS "window", total, {TIER_COLUMNS_SQL} FROM tiers""")
def option_rvol(spark, sf):
    out = run(spark, sf).rvol.select("session_date", "window", "total", "tier", "avg", "rvol", "n", "note", "flag")
    return rounded(out, "avg", "rvol")


@query("option_previous_session", f"""WITH {TAPE_SQL}, p AS (SELECT session_date, win, total,
  LAG(total) OVER (PARTITION BY win ORDER BY session_date) AS prev FROM totals)
SELECT session_date, win AS "window", total, prev, ROUND((total / NULLIF(prev, 0) - 1) * 100, 6) AS change_pct,
  CASE WHEN prev IS NULL THEN NULL WHEN COALESCE(total / NULLIF(prev, 0) - 1, 0) >= 0 THEN 'UP' ELSE 'DOWN' END
  AS direction FROM p""")
def option_previous_session(spark, sf):
    return rounded(R.previous_session(run(spark, sf).totals, ["window"], "session_date", "total"), "change_pct")


@query("option_contract_rank", f"""WITH {TAPE_SQL} SELECT session_date, win AS "window", generic_code, call, put, total,
  ROW_NUMBER() OVER (PARTITION BY session_date, win ORDER BY total DESC, generic_code) AS rank FROM slots WHERE total > 0""")
def option_contract_rank(spark, sf):
    return rank_contracts(T.window_slots(tape(spark, sf)), ["session_date", "window"], "total")


@query("option_windows_without_volume", f"""WITH {TAPE_SQL} SELECT session_date, win AS "window" FROM totals WHERE total <= 0""")
def option_windows_without_volume(spark, sf):
    return without_volume(run(spark, sf).totals, "total").select("session_date", "window")


_HISTORY = """SELECT m.session_date AS date, 'CT' AS commodity, o.total AS overnight_total, o.call AS overnight_call,
  o.put AS overnight_put, ROUND(o.put / NULLIF(o.call, 0), 6) AS overnight_pc_ratio, o.snapshot_ts AS overnight_snapshot_ts,
  d.total AS day_total, d.call AS day_call, d.put AS day_put, ROUND(d.put / NULLIF(d.call, 0), 6) AS day_pc_ratio,
  d.snapshot_ts_start AS day_snapshot_ts_start, d.snapshot_ts AS day_snapshot_ts_end
FROM marks m LEFT JOIN totals o ON o.session_date = m.session_date AND o.win = 'overnight'
LEFT JOIN totals d ON d.session_date = m.session_date AND d.win = 'day'"""


def _history(spark, sf, **kw):
    return rounded(run(spark, sf, **kw).history.drop("generated_at"), "overnight_pc_ratio", "day_pc_ratio")


@query("options_backfill_history", f"WITH {TAPE_SQL} {_HISTORY}")
def options_backfill_history(spark, sf):
    return _history(spark, sf)


@query("options_backfill_status", f"""WITH {TAPE_SQL} SELECT session_date, on_ts IS NOT NULL AS has_overnight,
  e_ts IS NOT NULL AS has_day, 0 AS code, concat_ws('; ', CASE WHEN on_ts IS NULL THEN 'no overnight snapshot' END,
  CASE WHEN e_ts IS NULL THEN 'no day snapshots' END) AS warning FROM marks WHERE day(session_date) <> 23
UNION ALL SELECT session_date, FALSE, FALSE, 1, 'no readable poll' FROM marks WHERE day(session_date) = 23""")
def options_backfill_status(spark, sf):
    """Every listed session; the poll times of one are no times, which leaves the others as they are."""
    text = F.date_format("snap_ts", "yyyy-MM-dd HH:mm:ss")
    written = F.when(F.dayofmonth("session_date") == 23, F.concat(F.lit("poll "), text)).otherwise(text)
    rows = tape(spark, sf).withColumn("snap_ts", written.try_cast("timestamp_ntz"))
    return P.options_sessions(rows, generated_at=AT, listed=rows.select("session_date").distinct()).status


@query("options_single_session", f"WITH {TAPE_SQL} SELECT * FROM ({_HISTORY}) h WHERE date = DATE '2024-01-17'")
def options_single_session(spark, sf):
    """The session job for one date, as the command line's date option selects it."""
    return _history(spark, sf, dates=["2024-01-17"])


@query("options_overnight_run_replaces_row", f"""WITH {TAPE_SQL}, h AS ({_HISTORY})
SELECT date, commodity, overnight_total, overnight_call, overnight_put, overnight_pc_ratio, overnight_snapshot_ts,
  CASE WHEN date <> DATE '2024-01-18' THEN day_total END AS day_total,
  CASE WHEN date <> DATE '2024-01-18' THEN day_call END AS day_call,
  CASE WHEN date <> DATE '2024-01-18' THEN day_put END AS day_put,
  CASE WHEN date <> DATE '2024-01-18' THEN day_pc_ratio END AS day_pc_ratio,
  CASE WHEN date <> DATE '2024-01-18' THEN day_snapshot_ts_start END AS day_snapshot_ts_start,
  CASE WHEN date <> DATE '2024-01-18' THEN day_snapshot_ts_end END AS day_snapshot_ts_end FROM h""")
def options_overnight_run_replaces_row(spark, sf):
    """A later overnight-only run replaces the whole history row of its date."""
    old = _history(spark, sf)
    new = _history(spark, sf, dates=["2024-01-18"], windows=("overnight",))
    return upsert(old, new, ["date", "commodity"])


@query("options_contract_history", f"""WITH {TAPE_SQL} SELECT session_date, generic_code,
  'CT' || CASE substr(generic_code, 3, 3) WHEN 'MAR' THEN 'H' WHEN 'MAY' THEN 'K' WHEN 'JUL' THEN 'N' ELSE 'Z' END ||
    CASE right(generic_code, 1) WHEN '1' THEN '4' ELSE '5' END AS ice_code,
  CASE substr(generic_code, 3, 3) WHEN 'MAR' THEN 'H' WHEN 'MAY' THEN 'K' WHEN 'JUL' THEN 'N' ELSE 'Z' END AS month_code,
  CASE substr(generic_code, 3, 3) WHEN 'MAR' THEN 'Mar' WHEN 'MAY' THEN 'May' WHEN 'JUL' THEN 'Jul' ELSE 'Dec' END AS month_name,
  CASE right(generic_code, 1) WHEN '1' THEN 2024 ELSE 2025 END AS delivery_year, win AS "window", total, call, put FROM slots""")
def options_contract_history(spark, sf):
    return P.contract_history(run(spark, sf))


@query("contract_history_december_overnight", f"""WITH {TAPE_SQL} SELECT session_date, generic_code,
  CASE right(generic_code, 1) WHEN '1' THEN 'CTZ4' ELSE 'CTZ5' END AS ice_code, total, call, put FROM slots
  WHERE generic_code LIKE 'CTDEC%' AND win = 'overnight' AND session_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def contract_history_december_overnight(spark, sf):
    rows = H.contract_history(P.contract_history(run(spark, sf)), start="2024-01-05", end="2024-01-25",
                              month_code="Z", window="overnight")
    return rows.select("session_date", "generic_code", "ice_code", "total", "call", "put")


@query("session_history_range", f"""WITH {TAPE_SQL}, h AS ({_HISTORY}) SELECT date, commodity, overnight_total, overnight_call,
  overnight_put, overnight_pc_ratio, overnight_snapshot_ts FROM h WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-26'""")
def session_history_range(spark, sf):
    return H.session_history(_history(spark, sf), "2024-01-08", "2024-01-26", window="overnight")


@query("session_history_summary", f"""WITH {TAPE_SQL}, h AS ({_HISTORY}) SELECT MIN(date) AS "from", MAX(date) AS "to",
  COUNT(*) AS count FROM h WHERE date >= DATE '2024-01-08'""")
def session_history_summary(spark, sf):
    rows = H.session_history(_history(spark, sf), "2024-01-08", fields=("date", "overnight_total"))
    return H.range_summary(rows, "date")


@query("universe_filter_impact", f"""WITH {TAPE_SQL}, other AS (
  SELECT t.session_date, t.contract,
    COALESCE(SUM(call_vol) FILTER (snap_ts = on_ts), 0) AS oc, COALESCE(SUM(put_vol) FILTER (snap_ts = on_ts), 0) AS op,
    GREATEST(0.0, COALESCE(SUM(call_vol) FILTER (snap_ts = e_ts), 0) - COALESCE(SUM(call_vol) FILTER (snap_ts = s_ts), 0)) AS dc,
    GREATEST(0.0, COALESCE(SUM(put_vol) FILTER (snap_ts = e_ts), 0) - COALESCE(SUM(put_vol) FILTER (snap_ts = s_ts), 0)) AS dp,
    COUNT(*) FILTER (snap_ts = on_ts) AS n_on, COUNT(*) FILTER (snap_ts = e_ts OR snap_ts = s_ts) AS n_day
  FROM tape t JOIN marks m ON m.session_date = t.session_date
  WHERE t.contract NOT IN (SELECT contract FROM slot_of) GROUP BY 1, 2),
every AS (SELECT session_date, win, call, put, TRUE AS tracked FROM slots
  UNION ALL SELECT session_date, 'overnight', oc, op, FALSE FROM other WHERE n_on > 0
  UNION ALL SELECT session_date, 'day', dc, dp, FALSE FROM other WHERE n_day > 0)
SELECT session_date, win AS "window", SUM(call + put) AS total, SUM(call) AS call, SUM(put) AS put,
  SUM(CASE WHEN tracked THEN call + put ELSE 0.0 END) AS total_universe,
  SUM(CASE WHEN tracked THEN call ELSE 0.0 END) AS call_universe, SUM(CASE WHEN tracked THEN put ELSE 0.0 END) AS put_universe,
  SUM(CASE WHEN tracked THEN 0.0 ELSE call + put END) AS dropped FROM every GROUP BY 1, 2""")
def universe_filter_impact(spark, sf):
    return T.filter_impact(tape(spark, sf))


@query("universe_rvol", f"""WITH {TAPE_SQL}, {tiers_sql('totals', 'win', 'session_date', 'total')}
SELECT session_date, win AS "window", total AS total_universe, tier, ROUND(avg_volume, 6) AS avg, ROUND(rvol, 6) AS rvol,
  n FROM tiers""")
def universe_rvol(spark, sf):
    """Trailing comparison of the tracked-slot column of the parallel totals."""
    out = R.trailing(T.filter_impact(tape(spark, sf)), ["window"], "session_date", "total_universe")
    return rounded(out.select("session_date", "window", "total_universe", "tier", "avg", "rvol", "n"), "avg", "rvol")


@query("short_sessions", f"""WITH {TAPE_SQL} SELECT session_date, MAX(snap_ts) AS last_ts,
  MAX(snap_ts) < CAST(session_date AS TIMESTAMP) + INTERVAL '860' MINUTE AS is_short FROM tape GROUP BY session_date""")
def short_sessions(spark, sf):
    return T.short_sessions(tape(spark, sf))


@query("open_day_rvol", f"""WITH {TAPE_SQL}, open_days AS (SELECT * FROM totals WHERE isodow(session_date) < 6),
{tiers_sql('open_days', 'win', 'session_date', 'total')}
SELECT session_date, win AS "window", total, {TIER_COLUMNS_SQL} FROM tiers""")
def open_day_rvol(spark, sf):
    """Lookbacks that count only open days: weekends and holidays leave the series first."""
    totals = run(spark, sf).totals.filter(~is_closed(F.col("session_date")))
    out = R.trailing(totals, ["window"], "session_date", "total")
    return rounded(out.select("session_date", "window", "total", "tier", "avg", "rvol", "n", "note", "flag"),
                   "avg", "rvol")


@query("option_payload_windows", f"""WITH {TAPE_SQL}, {tiers_sql('totals', 'win', 'session_date', 'total')},
c AS (SELECT session_date, win, COUNT(*) AS n_contracts, SUM(total) AS contract_total FROM slots GROUP BY 1, 2)
SELECT t.session_date, t.win AS "window", t.total, t.call, t.put, t.snapshot_ts, COALESCE(c.n_contracts, 0) AS n_contracts,
  COALESCE(c.contract_total, 0.0) AS contract_total, r.n AS n5, ROUND(r.rvol, 6) AS rvol5
FROM totals t LEFT JOIN c ON c.session_date = t.session_date AND c.win = t.win
LEFT JOIN tiers r ON r.session_date = t.session_date AND r.win = t.win AND r.tier = 5""")
def option_payload_windows(spark, sf):
    """The nested session payload, unfolded again to one row per window."""
    p = P.payload(run(spark, sf, settle=True))
    w = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"windows.{n}").alias("b"))
                            for n in T.WINDOWS])).alias("w")
    b = p.select("session_date", w).select("session_date", "w.window", "w.b").filter(F.col("b").isNotNull())
    tier = F.try_element_at("b.rvol", F.lit("5"))
    total = F.aggregate("b.by_contract", F.lit(0.0), lambda acc, x: acc + x["total"])
    return rounded(b.select("session_date", "window", "b.total", "b.call", "b.put", "b.snapshot_ts",
                            F.size("b.by_contract").cast("bigint").alias("n_contracts"),
                            total.alias("contract_total"), tier["n"].alias("n5"), tier["rvol"].alias("rvol5")), "rvol5")


@query("latest_session_pointer", f"""WITH {TAPE_SQL} SELECT MAX(session_date) AS session_date,
  TIMESTAMP '2024-02-01 00:00:00' AS generated_at, 'out/session_date=' || CAST(MAX(session_date) AS VARCHAR) AS path FROM marks""")
def latest_session_pointer(spark, sf):
    return P.latest_pointer(run(spark, sf).sessions.withColumn("generated_at", F.lit(AT).cast("timestamp_ntz")), "out")


def _n(c):
    return f"CASE WHEN {c} IS NULL THEN 'n/a' ELSE format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT)) END"


_FLAG = "CASE WHEN rvol >= 2.0 THEN '  *** HIGH (>=2x)' WHEN rvol <= 0.5 THEN '  *** LOW (<=0.5x)' ELSE '' END"


@query("options_report", f"""WITH {TAPE_SQL}, {tiers_sql('totals', 'win', 'session_date', 'total')},
blocks AS (SELECT session_date, win, CASE win WHEN 'overnight' THEN 1 ELSE 2 END AS section
  FROM (SELECT DISTINCT session_date FROM tape) d CROSS JOIN (VALUES ('overnight'), ('day')) w(win)),
prior AS (SELECT *, LAG(total) OVER (PARTITION BY win ORDER BY session_date) AS prev FROM totals),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_date, win ORDER BY total DESC, generic_code) AS rk
  FROM slots WHERE total > 0),
lines AS (
  SELECT DISTINCT session_date, 0 AS section, 0 AS ord, 'SESSION VOLUME -- CT -- ' || CAST(session_date AS VARCHAR) AS line FROM tape
  UNION ALL SELECT DISTINCT session_date, 0, 1, repeat('=', 60) FROM tape
  UNION ALL SELECT session_date, section, 0, '' FROM blocks
  UNION ALL SELECT session_date, section, 1, CASE win WHEN 'overnight' THEN 'OVERNIGHT (prev 21:00 -> 07:00 ET)'
    ELSE 'DAY (07:00 -> 14:20 ET)' END FROM blocks
  UNION ALL SELECT session_date, section, 2, repeat('-', 40) FROM blocks
  UNION ALL SELECT b.session_date, b.section, 3, '  No data for this window.' FROM blocks b
    WHERE NOT EXISTS (SELECT 1 FROM totals t WHERE t.session_date = b.session_date AND t.win = b.win)
  UNION ALL SELECT session_date, CASE win WHEN 'overnight' THEN 1 ELSE 2 END, u.ord, u.line FROM (
    SELECT session_date, win, unnest([
      {{'ord': 3, 'line': '  Total          : ' || {_n('total')}}},
      {{'ord': 4, 'line': '  Calls / Puts   : ' || {_n('call')} || ' / ' || {_n('put')} ||
        CASE WHEN COALESCE(put / NULLIF(call, 0), 0) = 0 THEN '' ELSE '   (P/C ' || printf('%.2f', round_even(put / call, 2)) || ')' END}},
      {{'ord': 5, 'line': '  Snapshot       : ' || COALESCE(strftime(snapshot_ts_start, '%Y-%m-%d %H:%M:%S') || ' -> ', '')
        || strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S')}},
      {{'ord': 7, 'line': ''}}, {{'ord': 200, 'line': ''}}, {{'ord': 201, 'line': '  By contract (total | call | put):'}},
      {{'ord': 300, 'line': CASE WHEN total <= 0 THEN '    (no volume recorded)' END}}]) AS u FROM totals) x WHERE u.line IS NOT NULL
  UNION ALL SELECT session_date, CASE win WHEN 'overnight' THEN 1 ELSE 2 END, 6, '  vs prev session: ' || {_n('prev')} ||
    CASE WHEN prev = 0 THEN '' ELSE '   ' || CASE WHEN total / prev - 1 >= 0 THEN 'UP' ELSE 'DOWN' END || ' ' ||
      CASE WHEN total / prev - 1 < 0 THEN '-' ELSE '+' END || printf('%.0f', abs(round_even((total / prev - 1) * 100, 0))) || '%' END
    FROM prior WHERE prev IS NOT NULL
  UNION ALL SELECT session_date, CASE win WHEN 'overnight' THEN 1 ELSE 2 END, 100 + tier, '  RVOL-' || lpad(CAST(tier AS VARCHAR), 2, ' ')
    || '  ' || CASE WHEN avg_volume IS NULL THEN 'n/a (0 sessions)' ELSE 'avg=' || lpad({_n('avg_volume')}, 9, ' ') || '  rvol=' ||
      COALESCE(printf('%.2f', round_even(rvol, 2)) || 'x', 'n/a') || {_FLAG} ||
      CASE WHEN n < tier THEN '  [n/a (have ' || n || ' of ' || tier || ')]' ELSE '' END END FROM tiers
  UNION ALL SELECT session_date, CASE win WHEN 'overnight' THEN 1 ELSE 2 END, 300 + rk, '    ' || rpad(generic_code, 8, ' ') || ' (CT' ||
    CASE substr(generic_code, 3, 3) WHEN 'MAR' THEN 'H' WHEN 'MAY' THEN 'K' WHEN 'JUL' THEN 'N' ELSE 'Z' END ||
    CASE right(generic_code, 1) WHEN '1' THEN '4/2024' ELSE '5/2025' END || ')  ' || lpad({_n('total')}, 9, ' ') || '  |  ' ||
    lpad({_n('call')}, 8, ' ') || '  |  ' || lpad({_n('put')}, 8, ' ') FROM ranked
  UNION ALL SELECT DISTINCT session_date, 9, 0, '' FROM tape
  UNION ALL SELECT DISTINCT session_date, 9, 1, 'Generated: 2024-02-01T00:00:00' FROM tape)
SELECT session_date, section, ord, line FROM lines""")
def options_report(spark, sf):
    return run(spark, sf, settle=True).report.withColumn("ord", F.col("ord").cast("bigint"))


def _json_window(w: str) -> str:
    return f"""(SELECT CAST(total AS DOUBLE) FROM totals t WHERE t.session_date = s.session_date AND win = '{w}') AS {w}_total,
  (SELECT CAST(put AS DOUBLE) FROM totals t WHERE t.session_date = s.session_date AND win = '{w}') AS {w}_put,
  CASE WHEN EXISTS (SELECT 1 FROM totals t WHERE t.session_date = s.session_date AND win = '{w}') THEN
    (SELECT COUNT(*) FROM slots t WHERE t.session_date = s.session_date AND win = '{w}') END AS {w}_contracts"""


@query("options_payload_json", f"""WITH {TAPE_SQL} SELECT s.session_date, 'CT' AS commodity,
  {_json_window('overnight')}, {_json_window('day')} FROM (SELECT DISTINCT session_date FROM tape) s""")
def options_payload_json(spark, sf):
    """The payload as one JSON document per session, with some of it picked out again by path."""
    p = P.payload(run(spark, sf, settle=True))
    documents = p.select("session_date", F.to_json(F.struct(*p.columns), {"ignoreNullFields": "false"}).alias("document"))

    def at(path: str, kind: str, name: str):
        return F.get_json_object("document", f"$.{path}").cast(kind).alias(name)

    windows = [c for w in ("overnight", "day") for c in (
        at(f"windows.{w}.total", "double", f"{w}_total"), at(f"windows.{w}.put", "double", f"{w}_put"),
        F.json_array_length(F.get_json_object("document", f"$.windows.{w}.by_contract")).cast("long").alias(f"{w}_contracts"))]
    return documents.select("session_date", at("commodity", "string", "commodity"), *windows)
