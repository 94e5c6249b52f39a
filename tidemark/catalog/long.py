"""Series of row grain, cut into blocks of rows: the windows of the session operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import TIER_COLUMNS_SQL, rounded, table, tiers_sql
from tidemark.catalog.registry import query
from tidemark.datasets import series as S
from tidemark.operators import blocks as K
from tidemark.operators import trailing as R

BLOCK_ROWS = 5_000
_ONE = "one AS (SELECT event_id, value FROM events)"


@query("event_series_rvol", f"""WITH {_ONE}, {tiers_sql('one', '', 'event_id', 'value')}
SELECT event_id, value, {TIER_COLUMNS_SQL} FROM tiers""")
def event_series_rvol(spark, sf):
    """All events as a single series, each against the 5 to 60 before it."""
    rows = R.trailing(table(spark, sf, "events").select("event_id", "value"), [], "event_id", "value", block_rows=BLOCK_ROWS)
    return rounded(rows.select("event_id", "value", "tier", "avg", "rvol", "n", "note", "flag"), "avg", "rvol")


@query("event_series_previous", """SELECT event_id, value, prev, ROUND((value / NULLIF(prev, 0) - 1) * 100, 6) AS change_pct,
  CASE WHEN prev IS NULL THEN NULL WHEN COALESCE(value / NULLIF(prev, 0) - 1, 0) >= 0 THEN 'UP' ELSE 'DOWN' END AS direction
FROM (SELECT event_id, value, LAG(value) OVER (ORDER BY event_id) AS prev FROM events WHERE value IS NOT NULL)""")
def event_series_previous(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return rounded(R.previous_session(rows, [], "event_id", "value", block_rows=BLOCK_ROWS), "change_pct")


@query("event_running_totals", """SELECT event_id, event_type, ROUND(SUM(value) OVER w, 4) AS total, COUNT(value) OVER w AS n FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def event_running_totals(spark, sf):
    """Running totals of three long series."""
    rows = table(spark, sf, "events").select("event_id", "event_type", "value", F.col("value").isNotNull().cast("long").alias("one"))
    out = K.running_totals(rows, ["event_type"], "event_id", {"total": "value", "n": "one"}, BLOCK_ROWS)
    return rounded(out.select("event_id", "event_type", "total", "n"), "total", digits=4)


@query("event_last_purchase", """SELECT event_id, LAST_VALUE(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events""")
def event_last_purchase(spark, sf):
    """The value of the purchase before each event, however long ago."""
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"))
    return K.last_before(rows, [], ["event_id"], {"last_purchase": "paid"}, BLOCK_ROWS).select("event_id", "last_purchase")


@query("price_percent_rank", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  ROUND(percent_rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice), 9) AS rank FROM lineitem""")
def price_percent_rank(spark, sf):
    """Percent rank of every line in all lines of its flag, of which there are three."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag")
    out = K.percent_rank(rows, ["l_returnflag"], "l_extendedprice", "rank", BLOCK_ROWS).drop("l_returnflag")
    return rounded(out, "rank", digits=9)


@query("order_price_extremes", """WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS value,
  percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) * 100 AS rk,
  (o_totalprice - AVG(o_totalprice) OVER (PARTITION BY o_orderstatus)) / NULLIF(stddev(o_totalprice) OVER (PARTITION BY o_orderstatus), 0) AS z,
  ln(o_totalprice / NULLIF(LAG(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 0)) AS lr FROM orders WHERE o_totalprice > 0)
SELECT o_orderkey, o_orderstatus, value, ROUND(rk, 6) AS rank, ROUND(z, 6) AS zscore,
  ROUND(stddev(lr) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) * 100, 6) AS vol_20d,
  CASE WHEN rk >= 95 THEN '!! HI' WHEN rk <= 5 THEN '!! LO' WHEN rk >= 90 THEN 'HI' WHEN rk <= 10 THEN 'LO' END AS flag FROM r""")
def order_price_extremes(spark, sf):
    """Rank, score and swing of every order among those of its status."""
    rows = table(spark, sf, "orders").filter("o_totalprice > 0").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("value"))
    return rounded(S.extremes(rows, "value", ["o_orderstatus"], "o_orderkey", block_rows=BLOCK_ROWS), "rank", "zscore", "vol_20d")


@query("order_price_signals", """WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS close,
  ln(o_totalprice / NULLIF(LAG(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 0)) AS lr FROM orders)
SELECT o_orderkey, o_orderstatus, close,
  ROUND(stddev(lr) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * sqrt(252) * 100, 6) AS hv30,
  ROUND(stddev(lr) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * sqrt(252) * 100, 6) AS hv60,
  ROUND((close - AVG(close) OVER y) / NULLIF(stddev(close) OVER y, 0), 6) AS zscore_1yr
FROM r WINDOW y AS (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def order_price_signals(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("close"))
    return rounded(S.vol_signals(rows, "close", ["o_orderstatus"], "o_orderkey", block_rows=BLOCK_ROWS), "hv30", "hv60", "zscore_1yr")


@query("order_price_average", """WITH s AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS paid,
  AVG(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS sma FROM orders)
SELECT o_orderkey, o_orderstatus, paid, ROUND(sma, 6) AS sma_paid,
  ROUND(LAG(sma, 13) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 6) AS lagged_sma_paid FROM s""")
def order_price_average(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("paid"))
    return rounded(S.moving_average(rows, "paid", ["o_orderstatus"], "o_orderkey", block_rows=BLOCK_ROWS), "sma_paid", "lagged_sma_paid")
