"""Streaming versions of the boundary queries, run over the events file as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import rounded, table, tape
from tidemark.catalog.boundaries import POLLS_SQL, as_polls
from tidemark.catalog.registry import SQL, query
from tidemark.operators.sizing import shared_folder
from tidemark.plans import options as P
from tidemark.sources.market import follow_tape
from tidemark.streaming import capture as L


def poll_stream(spark, sf):
    events = table(spark, sf, "events")
    return as_polls(spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf))


@query("streaming_boundary_capture", f"""WITH {POLLS_SQL} SELECT session_date, contract, boundary, "timestamp", volume, oi FROM captured""")
def streaming_boundary_capture(spark, sf):
    emitted = L.run_available(L.capture_stream(poll_stream(spark, sf)))
    return L.latest_rows(emitted, ["session_date", "contract", "boundary"])


@query("streaming_live_windows", f"""WITH {POLLS_SQL}, w AS (
  SELECT session_date, contract, MAX("timestamp") FILTER (boundary = 'open') AS t0,
    MAX(volume) FILTER (boundary = 'open') AS v0, MAX(volume) FILTER (boundary = '0700') AS v7,
    MAX(volume) FILTER (boundary = '1420') AS v14 FROM captured GROUP BY 1, 2),
l AS (SELECT session_date, contract, MAX(snap_ts) AS last_ts, MAX(volume) AS last_volume FROM polls WHERE oi IS NOT NULL GROUP BY 1, 2),
x AS (SELECT l.session_date, l.contract, l.last_ts, GREATEST(0.0, COALESCE(v7, last_volume) - v0) AS night,
  CASE WHEN v7 IS NOT NULL THEN GREATEST(0.0, COALESCE(v14, last_volume) - v7) END AS day
  FROM l JOIN w ON w.session_date = l.session_date AND w.contract = l.contract)
SELECT *, night + COALESCE(day, 0.0) AS "full" FROM x""")
def streaming_live_windows(spark, sf):
    emitted = L.run_available(L.live_windows(poll_stream(spark, sf)))
    return L.latest_rows(emitted, ["session_date", "contract"])


@query("streaming_completeness_alerts", f"""WITH {POLLS_SQL}, wm AS (SELECT MAX(snap_ts) - INTERVAL '10' MINUTE AS now FROM polls),
s AS (SELECT DISTINCT session_date FROM polls),
owed AS (SELECT s.session_date, b.boundary, CAST(s.session_date AS TIMESTAMP) + b.off * INTERVAL '1' MINUTE AS at FROM s CROSS JOIN bt b)
SELECT o.session_date, o.boundary FROM owed o, wm WHERE o.at + INTERVAL '5' MINUTE <= wm.now
  AND NOT EXISTS (SELECT 1 FROM polls p WHERE p.session_date = o.session_date AND p.oi IS NOT NULL AND p.contract <> 'CTV4'
    AND p.snap_ts >= o.at AND p.snap_ts < o.at + INTERVAL '5' MINUTE)""")
def streaming_completeness_alerts(spark, sf):
    emitted = L.run_available(L.completeness_alerts(poll_stream(spark, sf)), mode="append")
    return emitted.select("session_date", "boundary")


DAYS_AFTER = 7  # the clock goes on after the last poll, into sessions that have none


@query("streaming_empty_session_alerts", f"""WITH {POLLS_SQL}, span AS (SELECT MIN(session_date) AS lo, MAX(session_date) + {DAYS_AFTER} AS hi FROM polls),
days AS (SELECT CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
wm AS (SELECT GREATEST((SELECT MAX(snap_ts) FROM polls), CAST(hi AS TIMESTAMP) + INTERVAL '866' MINUTE) - INTERVAL '10' MINUTE AS now FROM span),
s AS (SELECT session_date FROM polls UNION SELECT d FROM days WHERE isodow(d) < 6),
owed AS (SELECT s.session_date, b.boundary, CAST(s.session_date AS TIMESTAMP) + b.off * INTERVAL '1' MINUTE AS at FROM s CROSS JOIN bt b)
SELECT o.session_date, o.boundary FROM owed o, wm WHERE o.at + INTERVAL '5' MINUTE <= wm.now
  AND NOT EXISTS (SELECT 1 FROM polls p WHERE p.session_date = o.session_date AND p.oi IS NOT NULL AND p.contract <> 'CTV4'
    AND p.snap_ts >= o.at AND p.snap_ts < o.at + INTERVAL '5' MINUTE)""")
def streaming_empty_session_alerts(spark, sf):
    """Alerts with a clock that ticks at each boundary of every date, also where no poll comes."""
    span = as_polls(table(spark, sf, "events")).agg(F.min("session_date").alias("lo"), F.date_add(F.max("session_date"), DAYS_AFTER).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("d")).select(F.col("d").cast("timestamp_ntz").alias("d"))
    minutes = F.explode(F.array(*[F.lit(m) for m in (-180, 426, 866)]))  # 21:00, 07:06 and 14:26
    folder = shared_folder(spark)
    days.select("d", minutes.alias("m")).select((F.col("d") + F.make_dt_interval(mins=F.col("m"))).alias("tick")).write.parquet(folder)
    ticks = spark.readStream.schema("tick timestamp_ntz").parquet(folder)
    emitted = L.run_available(L.completeness_alerts(poll_stream(spark, sf), beats=L.heartbeat(ticks)), mode="append")
    return emitted.select("session_date", "boundary")


@query("streaming_appended_tape", SQL["option_window_totals"])
def streaming_appended_tape(spark, sf):
    """Tape files that appear in three waves, cut in the middle of a session; each is read by a query that takes up the last."""
    root, folder = shared_folder(spark), shared_folder(spark)
    rows = tape(spark, sf)
    first, second = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-11 02:00:00", "2024-01-22 12:00:00"))
    wave = F.when(F.col("snap_ts") < first, 0).when(F.col("snap_ts") < second, 1).otherwise(2)
    cells = rows.withColumn("timestamp", F.date_format("snap_ts", "yyyy-MM-dd HH:mm:ss")).withColumn("wave", wave)
    for k in range(3):
        part = cells.filter(F.col("wave") == k).hint("rebalance", "session_date")
        part.select("session_date", "timestamp", "contract", "strike", "call_vol", "put_vol").write.mode("append") \
            .partitionBy("session_date").option("header", True).csv(root)
        polls = L.followed_polls(follow_tape(spark, root, files="session_date=*/*.csv"), folder)
    return rounded(P.options_sessions(polls).totals, "pc_ratio")
