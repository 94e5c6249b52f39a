"""Documented dataset queries over inputs derived from the generic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import pick, rounded, table
from tidemark.catalog.registry import query
from tidemark.operators.sizing import shared_folder
from tidemark.datasets import documents as D
from tidemark.datasets import interest as I
from tidemark.datasets import options_market as O
from tidemark.datasets import series as S
from tidemark.datasets import slices as L
from tidemark.datasets import stocks as K
from tidemark.datasets import term_index as X

# ---------------------------------------------------------------- inputs

# Months and positions of the derived board.
BOARD = ("MAR1", "MAR2", "MAY1", "MAY2", "JUL1", "JUL2", "DEC1", "DEC2", "OCT1", "OCT2")


def futures(spark, sf):
    """Daily futures board of four commodities: settlement, open interest, volume."""
    com = pick(F.col("l_suppkey") % 4, *L.COMMODITIES)
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_shipdate").cast("date").alias("date"), com.alias("commodity"),
        F.concat(com, pick(F.col("l_partkey") % 10, *BOARD)).alias("contract"),
    ).agg(F.max("l_extendedprice").alias("settle"), F.sum("l_quantity").alias("open_int"),
          F.count("*").alias("volume"))


_COM = "CASE l_suppkey % 4 WHEN 0 THEN 'CT' WHEN 1 THEN 'KC' WHEN 2 THEN 'CC' ELSE 'SB' END"
FUTURES_SQL = f"""
futures AS (
  SELECT CAST(l_shipdate AS DATE) AS date, {_COM} AS commodity,
    {_COM} || CASE l_partkey % 10 WHEN 0 THEN 'MAR1' WHEN 1 THEN 'MAR2' WHEN 2 THEN 'MAY1' WHEN 3 THEN 'MAY2' WHEN 4 THEN 'JUL1'
      WHEN 5 THEN 'JUL2' WHEN 6 THEN 'DEC1' WHEN 7 THEN 'DEC2' WHEN 8 THEN 'OCT1' ELSE 'OCT2' END AS contract,
    MAX(l_extendedprice) AS settle, SUM(l_quantity) AS open_int, COUNT(*) AS volume
  FROM lineitem GROUP BY 1, 2, 3)"""


def options(spark, sf):
    """Daily option rows: strike, put/call, contract month; dated by release."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_shipdate").cast("date").alias("date"),
        pick(F.col("l_suppkey") % 4, *L.COMMODITIES).alias("commodity"),
        F.concat(pick(F.col("l_partkey") % 4, "Mar ", "May ", "Jul ", "Dec "),
                 (F.year("l_shipdate") + 1).cast("string")).alias("contract_month"),
        F.when(F.col("l_returnflag") == "N", "C").otherwise("P").alias("put_call"),
        (60 + F.col("l_linenumber") * 2.5).cast("double").alias("strike_px"),
    ).agg(F.sum("l_quantity").alias("open_int"))


OPTIONS_SQL = f"""
options AS (
  SELECT CAST(l_shipdate AS DATE) AS date, {_COM} AS commodity,
    CASE l_partkey % 4 WHEN 0 THEN 'Mar ' WHEN 1 THEN 'May ' WHEN 2 THEN 'Jul ' ELSE 'Dec ' END || (year(l_shipdate) + 1) AS contract_month,
    CASE WHEN l_returnflag = 'N' THEN 'C' ELSE 'P' END AS put_call, CAST(60 + l_linenumber * 2.5 AS DOUBLE) AS strike_px,
    SUM(l_quantity) AS open_int FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""


def daily(spark, sf):
    """One row per order date: highest price, orders, value of the last customer number."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.max("o_totalprice").alias("close"), F.count("*").cast("double").alias("n"))


DAILY_SQL = """
daily AS (SELECT CAST(o_orderdate AS DATE) AS date, MAX(o_totalprice) AS close, CAST(COUNT(*) AS DOUBLE) AS n
  FROM orders GROUP BY 1)"""

# Delivery points.
POINTS = ("DFW", "GAL", "GSP", "HOU", "MEM")


def stocks(spark, sf):
    return table(spark, sf, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("date"), pick(F.col("o_custkey") % 5, *POINTS).alias("location"),
    ).agg(F.sum(F.col("o_custkey") % 500 + 1).alias("bales"))


STOCKS_SQL = """
stocks AS (SELECT CAST(o_orderdate AS DATE) AS date,
    CASE o_custkey % 5 WHEN 0 THEN 'DFW' WHEN 1 THEN 'GAL' WHEN 2 THEN 'GSP' WHEN 3 THEN 'HOU' ELSE 'MEM' END AS location,
    CAST(SUM(o_custkey % 500 + 1) AS BIGINT) AS bales FROM orders GROUP BY 1, 2),
stock_days AS (SELECT date, CAST(SUM(bales) AS BIGINT) AS total FROM stocks GROUP BY 1)"""


def cotton_bales(spark, sf):
    """Bale lots with quality: delivery point, color, leaf, staple, strength, crop year, months on certificate."""
    q = F.col("l_quantity").cast("bigint")
    return table(spark, sf, "lineitem").select(
        pick(F.col("l_suppkey") % 4, "DFW", "GAL", "HOU", "MEM").alias("point"),
        F.col("l_returnflag").alias("color"), F.col("l_linenumber").alias("leaf"), q.alias("bales"),
        (33 + F.col("l_partkey") % 7).alias("staple"), (20 + F.col("l_partkey") % 12).alias("strength"),
        F.year("l_shipdate").alias("crop_year"), F.col("l_suppkey").alias("warehouse"))


BALES_SQL = """
lots AS (SELECT CASE l_suppkey % 4 WHEN 0 THEN 'DFW' WHEN 1 THEN 'GAL' WHEN 2 THEN 'HOU' ELSE 'MEM' END AS point,
    l_returnflag AS color, l_linenumber AS leaf, CAST(l_quantity AS BIGINT) AS bales, 33 + l_partkey % 7 AS staple,
    20 + l_partkey % 12 AS strength, year(l_shipdate) AS crop_year, l_suppkey AS warehouse FROM lineitem)"""


# ---------------------------------------------------------------- open interest and spreads

@query("open_interest_latest", f"""WITH {FUTURES_SQL} SELECT * FROM futures
  WHERE (commodity, date) IN (SELECT commodity, MAX(date) FROM futures GROUP BY 1)""")
def open_interest_latest(spark, sf):
    """Latest date of every commodity."""
    return L.latest(futures(spark, sf), "date", ["commodity"])


@query("open_interest_daily", f"""WITH {FUTURES_SQL}, {OPTIONS_SQL}
SELECT 'futures' AS dataset, date, commodity, contract AS name, open_int FROM futures WHERE date = (SELECT MAX(date) FROM futures)
UNION ALL SELECT 'options', date, commodity, contract_month || ' ' || put_call || ' ' || CAST(CAST(strike_px * 10 AS INTEGER) AS VARCHAR),
  open_int FROM options WHERE date = (SELECT MAX(date) FROM options)""")
def open_interest_daily(spark, sf):
    """Two datasets, each at its own latest date."""
    fut = L.latest(futures(spark, sf), "date")
    opt = L.latest(options(spark, sf), "date")
    strike = (F.col("strike_px") * 10).cast("int").cast("string")
    name = F.concat_ws(" ", "contract_month", "put_call", strike)
    return fut.select(F.lit("futures").alias("dataset"), "date", "commodity", F.col("contract").alias("name"),
                      "open_int").unionByName(
        opt.select(F.lit("options").alias("dataset"), "date", "commodity", name.alias("name"), "open_int"))


@query("options_interest_latest_count", f"""WITH {OPTIONS_SQL}, ct AS (SELECT * FROM options WHERE commodity = 'CT')
SELECT MAX(date) AS last_date, COUNT(*) AS row_count, SUM(open_int) AS open_int FROM ct WHERE date = (SELECT MAX(date) FROM ct)""")
def options_interest_latest_count(spark, sf):
    rows = L.latest(L.where(options(spark, sf), commodity="CT"), "date")
    return rows.agg(F.max("date").alias("last_date"), F.count("*").alias("row_count"),
                    F.sum("open_int").alias("open_int"))


@query("options_interest_history", f"""WITH {OPTIONS_SQL} SELECT * FROM options WHERE commodity = 'KC' AND put_call = 'C'
  AND contract_month = 'Jul 1998' AND strike_px = 65.0 AND date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'""")
def options_interest_history(spark, sf):
    return I.options_history(options(spark, sf), commodity="kc", start="1996-01-01", end="1998-06-30",
                             month="Jul 1998", strike=65.0, pc="C")


@query("release_date_alignment", f"""WITH {FUTURES_SQL}, {OPTIONS_SQL},
b AS (SELECT *, CASE substr(contract, 3, 3) WHEN 'MAR' THEN 3 WHEN 'MAY' THEN 5 WHEN 'JUL' THEN 7 WHEN 'OCT' THEN 10 ELSE 12 END AS m,
    CAST(right(contract, 1) AS INTEGER) AS p FROM futures),
traded AS (SELECT *, CAST(date + CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END * INTERVAL '1' DAY AS DATE) AS release_date,
    upper(substr(contract, 3, 1)) || lower(substr(contract, 4, 2)) || ' ' ||
      (year(date) + CASE WHEN make_date(year(date), m, 1) >= date THEN 0 ELSE 1 END + p - 1) AS delivery FROM b)
SELECT o.commodity, o.date AS release_date, o.contract_month, o.put_call, o.strike_px, o.open_int, t.date AS trade_date,
  t.contract, t.settle FROM options o JOIN traded t ON t.commodity = o.commodity AND t.release_date = o.date
  AND t.delivery = o.contract_month""")
def release_date_alignment(spark, sf):
    """Options dated by release next to their future on the trade date one business day before."""
    return I.align_release(options(spark, sf), futures(spark, sf).drop("open_int", "volume"))


_CHAIN = f"""{FUTURES_SQL}, board AS (
  SELECT date, commodity, contract, settle, CASE substr(contract, 3, 3) WHEN 'MAR' THEN 3 WHEN 'MAY' THEN 5 WHEN 'JUL' THEN 7 ELSE 12 END AS m,
    CAST(right(contract, 1) AS INTEGER) AS p FROM futures WHERE contract NOT LIKE '__OCT_'),
placed AS (SELECT *, (year(date) + CASE WHEN make_date(year(date), m, 1) >= date THEN 0 ELSE 1 END + p - 1) * 100 + m AS delivery FROM board),
chained AS (SELECT date, commodity, contract AS front, ROW_NUMBER() OVER w AS k, LEAD(contract) OVER w AS back,
  settle - LEAD(settle) OVER w AS settle FROM placed WINDOW w AS (PARTITION BY date, commodity ORDER BY delivery)),
spreads AS (SELECT date, commodity, k, k || '-' || (k + 1) AS spread_label, front, back, settle FROM chained WHERE back IS NOT NULL)"""


@query("spread_chain", f"WITH {_CHAIN} SELECT date, commodity, spread_label, front, back, ROUND(settle, 4) AS settle FROM spreads")
def spread_chain(spark, sf):
    return rounded(I.spread_chain(futures(spark, sf)), "settle", digits=4)


@query("spread_chain_first_five", f"WITH {_CHAIN} SELECT date, commodity, spread_label, front, back, ROUND(settle, 4) AS settle FROM spreads WHERE k <= 5")
def spread_chain_first_five(spark, sf):
    return rounded(I.spread_chain(futures(spark, sf), pairs=5), "settle", digits=4)


@query("spread_latest", f"""WITH {_CHAIN}, ct AS (SELECT * FROM spreads WHERE commodity = 'CT')
SELECT date, commodity, spread_label, ROUND(settle, 4) AS settle FROM ct WHERE date = (SELECT MAX(date) FROM ct)""")
def spread_latest(spark, sf):
    ct = L.where(I.spread_chain(futures(spark, sf)), commodity="CT")
    return rounded(L.latest(ct, "date").drop("front", "back"), "settle", digits=4)


@query("spread_history", f"""WITH {_CHAIN} SELECT date, commodity, spread_label, ROUND(settle, 4) AS settle FROM spreads
  WHERE commodity = 'CT' AND spread_label = '1-2' AND date >= DATE '1997-01-01'""")
def spread_history(spark, sf):
    rows = L.where(I.spread_chain(futures(spark, sf)), "date", "1997-01-01", commodity="CT", spread_label="1-2")
    return rounded(rows.drop("front", "back"), "settle", digits=4)


@query("open_interest_change", f"""WITH {FUTURES_SQL} SELECT date, contract, open_int,
  open_int - LAG(open_int) OVER (PARTITION BY contract ORDER BY date) AS oi_chg FROM futures""")
def open_interest_change(spark, sf):
    return I.change(futures(spark, sf).select("date", "contract", "open_int"), ["contract"], "date", "open_int", "oi_chg")


# ---------------------------------------------------------------- stocks

@query("stock_headline", f"""WITH {STOCKS_SQL}, a AS (SELECT MAX(date) AS as_of FROM stock_days)
SELECT as_of, (SELECT total FROM stock_days WHERE date = as_of) AS total,
  (SELECT total FROM stock_days WHERE date = as_of) - (SELECT arg_max(total, date) FROM stock_days WHERE date < as_of) AS chg_1d,
  (SELECT MAX(total) FROM stock_days WHERE date > as_of - 364) AS hi_52w, (SELECT MIN(total) FROM stock_days WHERE date > as_of - 364) AS lo_52w,
  (SELECT MAX(total) FROM stock_days) AS hi_all,
  (SELECT MIN(date) FROM stock_days WHERE total = (SELECT MAX(total) FROM stock_days)) AS hi_all_date,
  (SELECT arg_max(total, date) FROM stock_days WHERE date <= as_of - INTERVAL '12' MONTH) AS ya_total,
  (SELECT MAX(date) FROM stock_days WHERE date <= as_of - INTERVAL '12' MONTH) AS ya_date FROM a""")
def stock_headline(spark, sf):
    return K.headline(K.daily_totals(stocks(spark, sf)))


@query("stock_by_location", f"""WITH {STOCKS_SQL}, c AS (SELECT *, bales - LAG(bales) OVER (PARTITION BY location ORDER BY date) AS chg,
  ROW_NUMBER() OVER (PARTITION BY location ORDER BY date DESC) AS rn FROM stocks)
SELECT location, date, bales, chg FROM c WHERE rn = 1""")
def stock_by_location(spark, sf):
    return K.by_location(stocks(spark, sf))


@query("stock_series", f"""WITH {STOCKS_SQL} SELECT date, {", ".join(f"SUM(bales) FILTER (location = '{p}') AS {p}" for p in POINTS[:4])},
  SUM(bales) FILTER (location = 'MEM') AS other, SUM(bales) AS total FROM stocks GROUP BY 1""")
def stock_series(spark, sf):
    """Full daily history with one column per named location, the others and the total."""
    wide = K.rows_to_years(stocks(spark, sf), ["date"], POINTS[:4], "location", "bales")
    return wide.withColumn("total", sum(F.coalesce(F.col(p), F.lit(0)) for p in (*POINTS[:4], "other")))


@query("stock_rolling_range", f"""WITH {STOCKS_SQL} SELECT location, date, bales AS total,
  MAX(bales) OVER w AS hi, MIN(bales) OVER w AS lo FROM stocks
  WINDOW w AS (PARTITION BY location ORDER BY date RANGE BETWEEN INTERVAL '364' DAY PRECEDING AND CURRENT ROW)""")
def stock_rolling_range(spark, sf):
    return K.rolling_range(stocks(spark, sf).withColumnRenamed("bales", "total"), ["location"])


_BUCKETS = "SUM(CASE WHEN staple = 33 THEN bales ELSE 0 END) AS s33, SUM(CASE WHEN staple = 34 THEN bales ELSE 0 END) AS s34, " \
    "SUM(CASE WHEN staple = 35 THEN bales ELSE 0 END) AS s35, SUM(CASE WHEN staple = 36 THEN bales ELSE 0 END) AS s36, " \
    "SUM(CASE WHEN staple >= 37 THEN bales ELSE 0 END) AS s37plus, SUM(bales) AS total"


@query("quality_matrix", f"""WITH {BALES_SQL} SELECT point, color, leaf, {_BUCKETS},
  CASE WHEN GROUPING(point) = 0 THEN CASE WHEN GROUPING(color) = 0 THEN 'cell' ELSE 'point' END
    WHEN GROUPING(color) = 0 THEN 'national' ELSE 'grand' END AS level
FROM lots GROUP BY GROUPING SETS ((point, color, leaf), (point), (color, leaf), ())""")
def quality_matrix(spark, sf):
    staple = F.col("staple")
    labels = {f"s{n}": staple == n for n in (33, 34, 35, 36)} | {"s37plus": staple >= 37}
    return K.matrix(cotton_bales(spark, sf), "point", ["color", "leaf"], "bales", labels)


@query("quality_point_totals", f"""WITH {BALES_SQL} SELECT p.point, COALESCE(SUM(l.bales), 0) AS grand_total
FROM (VALUES ('DFW'), ('GAL'), ('GSP'), ('HOU'), ('MEM')) p(point) LEFT JOIN lots l ON l.point = p.point GROUP BY 1""")
def quality_point_totals(spark, sf):
    """Every delivery point, also one without stock."""
    totals = cotton_bales(spark, sf).groupBy("point").agg(F.sum("bales").alias("grand_total"))
    points = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in POINTS])).alias("point"))
    return K.with_empty_points(points, totals, "point", "grand_total")


_GPT = ", ".join(f"COALESCE(SUM(bales) FILTER (strength = {n}), 0) AS gpt_{n}" for n in range(25, 30))


@query("strength_distribution", f"""WITH {BALES_SQL} SELECT COALESCE(point, 'national') AS point, {_GPT},
  COALESCE(SUM(bales) FILTER (strength >= 30), 0) AS gpt_30plus, COALESCE(SUM(bales) FILTER (strength < 25), 0) AS other,
  SUM(bales) AS total FROM lots GROUP BY ROLLUP (point)""")
def strength_distribution(spark, sf):
    bucket = F.when(F.col("strength") >= 30, "gpt_30plus").otherwise(F.concat(F.lit("gpt_"), F.col("strength").cast("string")))
    return K.distribution(cotton_bales(spark, sf).withColumn("bucket", bucket), "point", "bucket", "bales",
                          ("gpt_25", "gpt_26", "gpt_27", "gpt_28", "gpt_29", "gpt_30plus"))


_YEARS = tuple(range(1996, 2000))  # the derived rows start earlier and end later


@query("crop_year_distribution", f"""WITH {BALES_SQL} SELECT COALESCE(point, 'national') AS point,
  {", ".join(f'COALESCE(SUM(bales) FILTER (crop_year = {y}), 0) AS "{y}"' for y in _YEARS)},
  COALESCE(SUM(bales) FILTER (crop_year NOT BETWEEN {_YEARS[0]} AND {_YEARS[-1]}), 0) AS other, SUM(bales) AS total FROM lots GROUP BY ROLLUP (point)""")
def crop_year_distribution(spark, sf):
    return K.distribution(cotton_bales(spark, sf), "point", "crop_year", "bales", _YEARS)


@query("ageing_distribution", f"""WITH {BALES_SQL}, aged AS (SELECT bales, 'm' || (staple - 33) AS months,
    CASE WHEN leaf = 7 THEN 'NEW' ELSE point END AS point FROM lots)
SELECT COALESCE(months, 'national') AS months, COALESCE(SUM(bales) FILTER (point = 'DFW'), 0) AS "DFW", COALESCE(SUM(bales) FILTER (point = 'GAL'), 0) AS "GAL",
  COALESCE(SUM(bales) FILTER (point = 'GSP'), 0) AS "GSP", COALESCE(SUM(bales) FILTER (point = 'HOU'), 0) AS "HOU",
  COALESCE(SUM(bales) FILTER (point = 'MEM'), 0) AS "MEM", COALESCE(SUM(bales) FILTER (point = 'NEW'), 0) AS other,
  SUM(bales) AS total FROM aged GROUP BY ROLLUP (months)""")
def ageing_distribution(spark, sf):
    """Age by delivery point; a point without a column counts under other."""
    months = F.concat(F.lit("m"), (F.col("staple") - 33).cast("string"))
    point = F.when(F.col("leaf") == 7, "NEW").otherwise(F.col("point"))
    lots = cotton_bales(spark, sf).withColumn("months", months).withColumn("point", point)
    return K.distribution(lots, "months", "point", "bales", POINTS)


@query("warehouse_top_list", f"""WITH {BALES_SQL} SELECT warehouse, SUM(bales) AS bales FROM lots GROUP BY 1""")
def warehouse_top_list(spark, sf):
    return K.top_list(cotton_bales(spark, sf), ["warehouse"], "bales")


@query("warehouse_summary", f"""WITH {BALES_SQL}, w AS (SELECT warehouse, SUM(bales) FILTER (color <> 'R') AS bales FROM lots GROUP BY 1)
SELECT SUM(bales) AS total, COUNT(*) AS n, COUNT(*) FILTER (bales > 0) AS n_with_stock FROM w""")
def warehouse_summary(spark, sf):
    kept = cotton_bales(spark, sf).withColumn("bales", F.when(F.col("color") != "R", F.col("bales")))
    return K.stock_summary(kept.groupBy("warehouse").agg(F.sum("bales").alias("bales")), "bales")


# ---------------------------------------------------------------- positioning, signals

# Classes of participants.
_PARTS = ("producer", "swap", "mm", "other", "nonrep")


def reports(spark, sf):
    """Weekly long, short and spread positions per participant (weeks start on Monday, reported Tuesday)."""
    q = F.col("o_custkey") % 50 + 1
    who = pick(F.substring("o_orderpriority", 1, 1).cast("int") - 1, *_PARTS)
    return table(spark, sf, "orders").groupBy(
        F.date_add(F.date_trunc("week", "o_orderdate").cast("date"), 1).alias("report_date"), who.alias("participant"),
    ).agg(*[F.sum(F.when(F.col("o_orderstatus") == s, q).otherwise(0)).cast("double").alias(n)
            for s, n in (("O", "long"), ("F", "short"), ("P", "spread"))], F.sum(q).cast("double").alias("open_interest"))


_REPORTS = """
reports AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 1 AS report_date,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'producer' WHEN '2' THEN 'swap' WHEN '3' THEN 'mm' WHEN '4' THEN 'other' ELSE 'nonrep' END AS participant,
  CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN o_custkey % 50 + 1 ELSE 0 END) AS DOUBLE) AS long,
  CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN o_custkey % 50 + 1 ELSE 0 END) AS DOUBLE) AS short,
  CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN o_custkey % 50 + 1 ELSE 0 END) AS DOUBLE) AS spread,
  CAST(SUM(o_custkey % 50 + 1) AS DOUBLE) AS open_interest FROM orders GROUP BY 1, 2)"""


@query("positioning", f"""WITH {_REPORTS}, n AS (SELECT *, long - short AS net FROM reports)
SELECT *, long - LAG(long) OVER w AS chg_long, short - LAG(short) OVER w AS chg_short, spread - LAG(spread) OVER w AS chg_spread,
  net - LAG(net) OVER w AS chg_net, ROUND(net / NULLIF(open_interest, 0) * 100, 6) AS net_pct_oi
FROM n WINDOW w AS (PARTITION BY participant ORDER BY report_date)""")
def positioning(spark, sf):
    return rounded(I.positioning(reports(spark, sf)), "net_pct_oi")


@query("positioning_latest", f"""WITH {_REPORTS} SELECT report_date, participant, long, short, open_interest, open_interest AS oi
  FROM reports WHERE report_date = (SELECT MAX(report_date) FROM reports)""")
def positioning_latest(spark, sf):
    rows = L.latest(reports(spark, sf), "report_date")
    return rows.select("report_date", "participant", "long", "short", "open_interest", F.col("open_interest").alias("oi"))


@query("positioning_last_weeks", f"""WITH {_REPORTS} SELECT report_date, long - short AS mm_net, spread AS mm_spread FROM reports
  WHERE participant = 'mm' ORDER BY report_date DESC LIMIT 52""")
def positioning_last_weeks(spark, sf, weeks="many", default=52):
    """Last weeks, newest first; here an invalid week count means 52."""
    mm = reports(spark, sf).filter(F.col("participant") == "mm")
    return L.newest(mm, "report_date", L.weeks_or_default(weeks, default)).select(
        "report_date", (F.col("long") - F.col("short")).alias("mm_net"), F.col("spread").alias("mm_spread"))


@query("positioning_all_weeks", f"""WITH {_REPORTS} SELECT report_date, long - short AS mm_net, spread AS mm_spread FROM reports
  WHERE participant = 'mm'""")
def positioning_all_weeks(spark, sf):
    """Without a number, every week."""
    return positioning_last_weeks(spark, sf, None, None)


@query("signals_newest", f"WITH {DAILY_SQL} SELECT date, close, n FROM daily ORDER BY date DESC LIMIT 30")
def signals_newest(spark, sf):
    return L.by_date_or_newest(daily(spark, sf), "date", rows=30)


@query("signals_all", f"WITH {DAILY_SQL} SELECT date, close, n FROM daily")
def signals_all(spark, sf):
    """Neither a date nor a number of rows: the whole series."""
    return L.by_date_or_newest(daily(spark, sf), "date")


@query("signals_on_date", f"WITH {DAILY_SQL} SELECT date, close, n FROM daily WHERE date = DATE '1996-03-14'")
def signals_on_date(spark, sf):
    """An exact date wins over the number of rows."""
    return L.by_date_or_newest(daily(spark, sf), "date", exact="1996-03-14", rows=30)


@query("volatility_signals", f"""WITH {FUTURES_SQL}, d AS (SELECT commodity, date, MAX(settle) AS close FROM futures GROUP BY 1, 2),
r AS (SELECT *, ln(close / NULLIF(LAG(close) OVER (PARTITION BY commodity ORDER BY date), 0)) AS lr FROM d)
SELECT commodity, date, close,
  ROUND(stddev(lr) OVER (PARTITION BY commodity ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * sqrt(252) * 100, 6) AS hv30,
  ROUND(stddev(lr) OVER (PARTITION BY commodity ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * sqrt(252) * 100, 6) AS hv60,
  ROUND((close - AVG(close) OVER y) / NULLIF(stddev(close) OVER y, 0), 6) AS zscore_1yr
FROM r WINDOW y AS (PARTITION BY commodity ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def volatility_signals(spark, sf):
    """Volatility and position of every commodity's daily close."""
    close = futures(spark, sf).groupBy("commodity", "date").agg(F.max("settle").alias("close"))
    return rounded(S.vol_signals(close, "close", ["commodity"], "date"), "hv30", "hv60", "zscore_1yr")


@query("series_extremes", f"""WITH {_REPORTS}, n AS (SELECT participant, report_date, long AS value FROM reports),
r AS (SELECT *, percent_rank() OVER (PARTITION BY participant ORDER BY value) * 100 AS rk,
  (value - AVG(value) OVER (PARTITION BY participant)) / NULLIF(stddev(value) OVER (PARTITION BY participant), 0) AS z,
  ln(value / NULLIF(LAG(value) OVER (PARTITION BY participant ORDER BY report_date), 0)) AS lr FROM n WHERE value > 0)
SELECT participant, report_date, value, ROUND(rk, 6) AS rank, ROUND(z, 6) AS zscore,
  ROUND(stddev(lr) OVER (PARTITION BY participant ORDER BY report_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) * 100, 6) AS vol_20d,
  CASE WHEN rk >= 95 THEN '!! HI' WHEN rk <= 5 THEN '!! LO' WHEN rk >= 90 THEN 'HI' WHEN rk <= 10 THEN 'LO' END AS flag FROM r""")
def series_extremes(spark, sf):
    one = reports(spark, sf).select("participant", "report_date", F.col("long").alias("value")).filter("value > 0")
    return rounded(S.extremes(one, "value", ["participant"], "report_date"), "rank", "zscore", "vol_20d")


@query("on_call_latest", """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS report_date, o_orderpriority AS delivery_month,
  COUNT(*) AS unfixed_sales FROM orders GROUP BY 1, 2) SELECT * FROM c WHERE report_date = (SELECT MAX(report_date) FROM c)""")
def on_call_latest(spark, sf):
    rows = table(spark, sf, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("report_date"), F.col("o_orderpriority").alias("delivery_month"),
    ).agg(F.count("*").alias("unfixed_sales"))
    return L.latest(rows, "report_date")


# ---------------------------------------------------------------- basis, weather, exports

_BASIS = """
basis AS (SELECT CAST(l_shipdate AS DATE) AS report_date, n_name AS region, l_returnflag AS color, l_linenumber AS leaf,
    33 + l_partkey % 7 AS staple, l_linestatus AS cotton_type, l_partkey % 1000 - 500 AS basis_points, l_orderkey AS record
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


def basis(spark, sf, start=None, end=None, rows=None, **equals):
    """Basis records with their region, filtered, newest first up to ``rows`` where that is asked for."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("report_date"), F.col("l_returnflag").alias("color"),
        F.col("l_linenumber").alias("leaf"), (33 + F.col("l_partkey") % 7).alias("staple"),
        F.col("l_linestatus").alias("cotton_type"), (F.col("l_partkey") % 1000 - 500).alias("basis_points"),
        F.col("l_orderkey").alias("record"))
    named = lines.join(supplier, "l_suppkey").join(nation, "s_nationkey").drop("l_suppkey", "s_nationkey")
    return L.newest(L.where(named, "report_date", start, end, **equals), "report_date", rows, "record", "leaf", "basis_points")


@query("basis_records", f"WITH {_BASIS} SELECT * FROM basis WHERE color = 'N' AND report_date >= DATE '1996-01-01'")
def basis_records(spark, sf):
    """Records from a date on, all of them."""
    return basis(spark, sf, "1996-01-01", color="N")


@query("basis_records_filtered", f"""WITH {_BASIS} SELECT * FROM basis WHERE report_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'
  AND region = 'GERMANY' AND staple = 35 AND cotton_type = 'O'""")
def basis_records_filtered(spark, sf):
    """Date range, region, staple and cotton type together."""
    return basis(spark, sf, "1996-01-01", "1997-06-30", region="GERMANY", staple=35, cotton_type="O")


@query("basis_records_newest", f"""WITH {_BASIS} SELECT * FROM basis WHERE region = 'FRANCE'
  ORDER BY report_date DESC, record, leaf, basis_points LIMIT 500""")
def basis_records_newest(spark, sf):
    """The newest 500 of a region: the limit comes after every filter."""
    return basis(spark, sf, rows=500, region="FRANCE")


def weather(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(
        F.concat(F.lit("ST"), (F.col("user_id") % 20).cast("string")).alias("station"), F.col("ts").cast("date").alias("date"),
        (F.col("event_type") == "signup").cast("int").alias("forecast"),
    ).agg(F.count("*").alias("n"), F.max("value").alias("precip"))


_WEATHER = """
weather AS (SELECT 'ST' || (user_id % 20) AS station, CAST(ts AS DATE) AS date, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS forecast,
  COUNT(*) AS n, MAX(value) AS precip FROM events GROUP BY 1, 2, 3)"""


@query("rain_history_and_forecast", f"""WITH {_WEATHER} SELECT *, CASE WHEN forecast = 1 THEN 'forecast' ELSE 'history' END AS part
  FROM weather WHERE forecast = 1 OR date >= DATE '2024-01-15'""")
def rain_history_and_forecast(spark, sf):
    """The start date limits the history rows only."""
    return S.history_and_forecast(weather(spark, sf), "date", "forecast", "2024-01-15")


@query("station_cumulative", f"""WITH {_WEATHER}, d AS (SELECT station, date, SUM(n) AS chu FROM weather GROUP BY 1, 2)
SELECT station, date, chu, SUM(chu) OVER (PARTITION BY station, year(date) ORDER BY date) AS cum_chu FROM d""")
def station_cumulative(spark, sf):
    d = weather(spark, sf).groupBy("station", "date").agg(F.sum("n").alias("chu")).withColumn("season", F.year("date"))
    return d.withColumn("cum_chu", S.running_total("chu", ["station", "season"], "date")).drop("season")


@query("export_weeks_text_dates", """WITH t AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a'
    ELSE strftime(o_orderdate, '%m/%d/%Y') END AS week_date, o_custkey % 100 AS net FROM orders),
w AS (SELECT week_date, CAST(SUM(net) AS BIGINT) AS net_sales FROM t GROUP BY 1),
d AS (SELECT *, CAST(try_strptime(week_date, '%m/%d/%Y') AS DATE) AS day FROM w)
SELECT week_date, net_sales, day, (SELECT MAX(day) FROM d) AS as_of FROM d WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")
def export_weeks_text_dates(spark, sf):
    """Weekly rows dated MM/DD/YYYY: as-of date and range filter; unreadable dates drop out."""
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "n/a").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    weeks = table(spark, sf, "orders").groupBy(text.alias("week_date")).agg(F.sum(F.col("o_custkey") % 100).alias("net_sales"))
    dated = weeks.withColumn("day", S.text_date(F.col("week_date")))
    as_of = dated.select(F.max("day")).scalar()
    return L.where(dated, "day", "1997-01-01", "1997-12-31").withColumn("as_of", as_of)


@query("two_source_running_totals", """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS cb,
    COUNT(*) FILTER (o_orderstatus <> 'P') AS esr FROM orders GROUP BY 1),
y AS (SELECT *, CAST(year(month) - CASE WHEN month(month) < 8 THEN 1 ELSE 0 END AS INTEGER) AS my, CAST(year(month) AS INTEGER) AS cy FROM m),
c AS (SELECT *, SUM(cb) OVER (PARTITION BY my ORDER BY month) AS cb_my_cum, SUM(cb) OVER (PARTITION BY cy ORDER BY month) AS cb_cy_cum,
  SUM(esr) OVER (PARTITION BY my ORDER BY month) AS esr_my_cum, SUM(esr) OVER (PARTITION BY cy ORDER BY month) AS esr_cy_cum FROM y)
SELECT *, esr - cb AS diff, esr_my_cum - cb_my_cum AS my_diff FROM c""")
def two_source_running_totals(spark, sf):
    months = table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(
        F.count("*").alias("cb"), F.count_if(F.col("o_orderstatus") != "P").alias("esr"))
    return S.two_source_totals(months, "month", "cb", "esr")


@query("thirteen_week_average", f"""WITH {_REPORTS}, w AS (SELECT participant AS destination, report_date, long AS shipments FROM reports),
s AS (SELECT *, AVG(shipments) OVER (PARTITION BY destination ORDER BY report_date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS sma FROM w)
SELECT destination, report_date, shipments, ROUND(sma, 6) AS sma_shipments,
  ROUND(LAG(sma, 13) OVER (PARTITION BY destination ORDER BY report_date), 6) AS lagged_sma_shipments FROM s""")
def thirteen_week_average(spark, sf):
    """Moving average of every destination's weekly shipments."""
    weeks = reports(spark, sf).select(F.col("participant").alias("destination"), "report_date", F.col("long").alias("shipments"))
    return rounded(S.moving_average(weeks, "shipments", ["destination"], "report_date"), "sma_shipments", "lagged_sma_shipments")


@query("crop_progress", """WITH p AS (SELECT n_name AS state, year(o_orderdate) AS yr, week(o_orderdate) AS wk, CAST(COUNT(*) AS DOUBLE) AS pct
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3),
a AS (SELECT *, (SELECT q.pct FROM p q WHERE q.state = p.state AND q.wk = p.wk AND q.yr = p.yr - 1) AS prev_yr,
    (SELECT AVG(q.pct) FROM p q WHERE q.state = p.state AND q.wk = p.wk AND q.yr BETWEEN p.yr - 3 AND p.yr - 1) AS a3,
    (SELECT AVG(q.pct) FROM p q WHERE q.state = p.state AND q.wk = p.wk AND q.yr BETWEEN p.yr - 5 AND p.yr - 1) AS a5,
    pct - LAG(pct) OVER (PARTITION BY state, yr ORDER BY wk) AS wow_chg FROM p)
SELECT state, yr, wk, pct, prev_yr, ROUND(a3, 6) AS avg_3yr, ROUND(a5, 6) AS avg_5yr, wow_chg, pct - prev_yr AS vs_prev,
  ROUND(pct - a3, 6) AS vs_3yr, ROUND(pct - a5, 6) AS vs_5yr FROM a""")
def crop_progress(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    # counted per customer first, so a customer with most of the orders is one row per week
    orders = table(spark, sf, "orders").groupBy(
        "o_custkey", F.year("o_orderdate").alias("yr"), F.weekofyear("o_orderdate").alias("wk")).agg(F.count("*").alias("n"))
    weeks = orders.join(cust, "o_custkey").join(nation, "c_nationkey").groupBy("state", "yr", "wk").agg(
        F.sum("n").cast("double").alias("pct"))
    return rounded(S.progress(weeks, "state", "yr", "wk", "pct"), "avg_3yr", "avg_5yr", "vs_3yr", "vs_5yr")


# ---------------------------------------------------------------- balance sheets

# Lines of a balance sheet.
_ATTRS = ("BegStk", "Prod", "Imports", "DomUse", "Exports", "EndStk")


def sheets(spark, sf):
    """Balance sheet rows (region, year, attribute, value) from shipped quantities."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region"))
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    # summed per supplier first, so a supplier with most of the lines is a handful of rows
    rows = table(spark, sf, "lineitem").groupBy(
        "l_suppkey", F.year("l_shipdate").alias("yr"), pick(F.col("l_partkey") % 6, *_ATTRS).alias("attribute"),
    ).agg(F.sum("l_quantity").alias("value"))
    return rows.join(sup, "l_suppkey").join(nation, "s_nationkey").groupBy("region", "yr", "attribute").agg(
        F.sum("value").alias("value"))


_SHEETS = """
sheets AS (SELECT n_name AS region, year(l_shipdate) AS yr, CASE l_partkey % 6 WHEN 0 THEN 'BegStk' WHEN 1 THEN 'Prod' WHEN 2 THEN 'Imports'
    WHEN 3 THEN 'DomUse' WHEN 4 THEN 'Exports' ELSE 'EndStk' END AS attribute, SUM(l_quantity) AS value
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3),
wide AS (SELECT region, yr, """ + ", ".join(f"SUM(value) FILTER (attribute = '{a}') AS {a}" for a in _ATTRS) + """ FROM sheets GROUP BY 1, 2)"""


@query("balance_sheet_identities", f"""WITH {_SHEETS} SELECT *, BegStk + Prod + Imports AS Supply, DomUse + Exports AS TotalUse,
  BegStk + Prod + Imports - (DomUse + Exports) - EndStk AS Unacct FROM wide""")
def balance_sheet_identities(spark, sf):
    wide = sheets(spark, sf).groupBy("region", "yr").pivot("attribute", list(_ATTRS)).agg(F.sum("value"))
    return K.balance_identities(wide)


@query("balance_sheet_years_to_rows", f"""WITH {_SHEETS} SELECT s.region, s.attribute, CAST(y.yr AS VARCHAR) AS year, v.value
  FROM (SELECT DISTINCT region, attribute FROM sheets) s CROSS JOIN (VALUES {", ".join(f"({y})" for y in _YEARS)}) y(yr)
  LEFT JOIN sheets v ON v.region = s.region AND v.attribute = s.attribute AND v.yr = y.yr
UNION ALL SELECT region, attribute, 'other', SUM(value) FILTER (yr NOT BETWEEN {_YEARS[0]} AND {_YEARS[-1]}) FROM sheets GROUP BY 1, 2""")
def balance_sheet_years_to_rows(spark, sf):
    """Years as columns and back to rows; a year without a value stays as a null row."""
    wide = K.rows_to_years(sheets(spark, sf), ["region", "attribute"], _YEARS, "yr", "value")
    return K.years_to_rows(wide, ["region", "attribute"], [*map(str, _YEARS), "other"], "year", "value")


# ---------------------------------------------------------------- options market

def flow(spark, sf):
    return table(spark, sf, "events").select(
        F.col("ts").cast("date").alias("snapshot_date"), "event_id", (F.col("user_id") % 400).alias("volume"),
        pick(F.col("user_id") % 4, "callspread", "putspread", "straddle", "put").alias("parsed_structure"),
        pick(F.col("user_id") % 3, "CTZ4", "CTH5", "CTK5").alias("parsed_month"),
        (F.col("event_type") != "error").alias("grammar_valid"), (F.col("value") > 80).alias("review_flag"))


_FLOW = """
flow AS (SELECT CAST(ts AS DATE) AS snapshot_date, event_id, user_id % 400 AS volume,
  CASE user_id % 4 WHEN 0 THEN 'callspread' WHEN 1 THEN 'putspread' WHEN 2 THEN 'straddle' ELSE 'put' END AS parsed_structure,
  CASE user_id % 3 WHEN 0 THEN 'CTZ4' WHEN 1 THEN 'CTH5' ELSE 'CTK5' END AS parsed_month, event_type <> 'error' AS grammar_valid,
  value > 80 AS review_flag FROM events),
kept AS (SELECT * FROM flow WHERE snapshot_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND grammar_valid AND volume >= 100
  AND parsed_structure = 'putspread' AND parsed_month = 'CTZ4')"""

_FLOW_FILTER = dict(start="2024-01-05", end="2024-01-20", grammar_valid=True, min_volume=100, structure="putspread", month="CTZ4")


@query("parsed_flow", f"WITH {_FLOW} SELECT * FROM kept")
def parsed_flow(spark, sf):
    return O.parsed_flow(flow(spark, sf), **_FLOW_FILTER)


@query("parsed_flow_counts", f"""WITH {_FLOW} SELECT COUNT(*) AS count, COUNT(*) FILTER (grammar_valid) AS grammar_valid_count,
  COUNT(*) FILTER (review_flag) AS review_flag_count FROM flow WHERE volume >= 1""")
def parsed_flow_counts(spark, sf):
    return L.counts(O.parsed_flow(flow(spark, sf)), grammar_valid_count=F.col("grammar_valid"),
                    review_flag_count=F.col("review_flag"))


def chain(spark, sf):
    """Options chain of every order month: 41 strikes around 75, gamma given."""
    strike = (60 + F.col("o_custkey") % 41 * 0.75).cast("double")
    return table(spark, sf, "orders").groupBy(
        F.date_trunc("month", "o_orderdate").cast("date").alias("trade_date"), strike.alias("strike"),
        F.when(F.col("o_orderstatus") == "O", "C").otherwise("P").alias("put_call"),
    ).agg(F.count("*").cast("double").alias("open_int")).select(
        "*", (1 / (1 + F.abs(F.col("strike") - 75) * 8)).alias("gamma"), F.lit(75.0).alias("forward"),
        F.lit(0.25).alias("vol"), F.lit(0.5).alias("years"))


_GEX_CHAIN = """
chain AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date, CAST(60 + o_custkey % 41 * 0.75 AS DOUBLE) AS strike,
    CASE WHEN o_orderstatus = 'O' THEN 'C' ELSE 'P' END AS put_call, CAST(COUNT(*) AS DOUBLE) AS open_int FROM orders GROUP BY 1, 2, 3),
g AS (SELECT *, 1 / (1 + abs(strike - 75) * 8) AS gamma FROM chain)"""


@query("gamma_exposure", f"""WITH {_GEX_CHAIN}, s AS (SELECT trade_date, strike, SUM(gamma * open_int) FILTER (put_call = 'C') AS cg,
    SUM(gamma * open_int) FILTER (put_call = 'P') AS pg FROM g GROUP BY 1, 2),
n AS (SELECT trade_date, SUM(COALESCE(cg, 0) - COALESCE(pg, 0)) AS net, COUNT(*) AS n_strikes FROM s GROUP BY 1),
c AS (SELECT trade_date, strike, ROW_NUMBER() OVER (PARTITION BY trade_date ORDER BY cg DESC, strike) AS rn FROM s WHERE cg IS NOT NULL),
p AS (SELECT trade_date, strike, ROW_NUMBER() OVER (PARTITION BY trade_date ORDER BY pg DESC, strike) AS rn FROM s WHERE pg IS NOT NULL)
SELECT n.trade_date, ROUND(net, 6) AS net_gex_contracts, c.strike AS call_wall, p.strike AS put_wall, n_strikes,
  ROUND(net * 500, 4) AS net_gex_dollars, n_strikes < 20 AS is_thin FROM n
LEFT JOIN c ON c.trade_date = n.trade_date AND c.rn = 1 LEFT JOIN p ON p.trade_date = n.trade_date AND p.rn = 1""")
def gamma_exposure(spark, sf):
    out = O.gamma_exposure(chain(spark, sf))
    return rounded(rounded(out, "net_gex_contracts"), "net_gex_dollars", digits=4)


@query("gamma_series_range", f"""WITH {_GEX_CHAIN}, s AS (SELECT trade_date, SUM(CASE WHEN put_call = 'C' THEN gamma * open_int ELSE -gamma * open_int END)
  AS net, COUNT(DISTINCT strike) AS n_strikes FROM g GROUP BY 1)
SELECT trade_date, ROUND(net, 6) AS net_gex_contracts, n_strikes FROM s WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
def gamma_series_range(spark, sf):
    """Date range and field subset of the gamma series."""
    out = L.where(O.gamma_exposure(chain(spark, sf)), "trade_date", "1996-01-01", "1997-12-31")
    return rounded(out.select("trade_date", "net_gex_contracts", "n_strikes"), "net_gex_contracts")


@query("gamma_latest", f"WITH {_GEX_CHAIN} SELECT MAX(trade_date) AS trade_date, COUNT(DISTINCT trade_date) AS n_dates FROM chain")
def gamma_latest(spark, sf):
    return chain(spark, sf).agg(F.max("trade_date").alias("trade_date"), F.count_distinct("trade_date").alias("n_dates"))


_TERRAIN = f"""{_GEX_CHAIN}, lots AS (SELECT trade_date, strike, SUM(CASE WHEN put_call = 'C' THEN open_int ELSE -open_int END) AS lots FROM chain GROUP BY 1, 2),
grid AS (SELECT trade_date, k, 75.0 * (1 + k * 0.01) AS spot, strike, lots FROM lots, (SELECT unnest(range(-45, 46)) AS k) r),
d AS (SELECT *, (ln(spot / strike) + 0.5 * 0.25 * 0.25 * 0.5) / (0.25 * sqrt(0.5)) AS d1 FROM grid),
terrain AS (SELECT trade_date, k, spot, SUM(exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot * 0.25 * sqrt(0.5)) * lots) AS net FROM d GROUP BY 1, 2, 3)"""


@query("gamma_terrain", f"WITH {_TERRAIN} SELECT trade_date, CAST(k AS INTEGER) AS k, ROUND(spot, 6) AS spot, ROUND(net, 6) AS net_gex FROM terrain")
def gamma_terrain(spark, sf):
    return rounded(O.terrain(chain(spark, sf)).select("trade_date", "k", "spot", "net_gex"), "spot", "net_gex")


@query("gamma_balance", f"""WITH {_TERRAIN}, p AS (SELECT *, LAG(spot) OVER w AS s0, LAG(net) OVER w AS g0 FROM terrain
  WINDOW w AS (PARTITION BY trade_date ORDER BY k)),
c AS (SELECT trade_date, CASE WHEN net = 0 THEN spot ELSE s0 + (spot - s0) * g0 / (g0 - net) END AS b, g0 < 0 AND net > 0 AS up FROM p
  WHERE sign(g0) * sign(net) < 0 OR net = 0)
SELECT d.trade_date, ROUND(arg_min(b, abs(b - 75.0)), 5) AS balance, ROUND(arg_min(b, abs(b - 75.0)) FILTER (up), 5) AS gamma_flip,
  COUNT(b) AS n_crossings FROM (SELECT DISTINCT trade_date FROM chain) d LEFT JOIN c ON c.trade_date = d.trade_date GROUP BY 1""")
def gamma_balance(spark, sf):
    return rounded(O.balance_points(O.terrain(chain(spark, sf))), "balance", "gamma_flip", digits=5)


@query("gamma_speed_peak", f"""WITH {_TERRAIN}, p AS (SELECT trade_date, k, (spot + LAG(spot) OVER w) / 2 - 75.0 AS off,
  ROUND(abs(net - LAG(net) OVER w), 9) AS step FROM terrain WINDOW w AS (PARTITION BY trade_date ORDER BY k))
SELECT trade_date, ROUND(off, 6) AS speed_peak_offset FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY trade_date ORDER BY step DESC, k) AS rn
  FROM p WHERE step IS NOT NULL) q WHERE rn = 1""")
def gamma_speed_peak(spark, sf):
    return rounded(O.speed_peak(O.terrain(chain(spark, sf))), "speed_peak_offset")


@query("gamma_vol_sensitivity", f"""WITH {_TERRAIN}, d2 AS (SELECT trade_date, lots,
    exp(-pow((ln(75.0 / strike) + 0.5 * 0.26 * 0.26 * 0.5) / (0.26 * sqrt(0.5)), 2) / 2) / sqrt(2 * pi()) / (75.0 * 0.26 * sqrt(0.5)) AS up,
    exp(-pow((ln(75.0 / strike) + 0.5 * 0.25 * 0.25 * 0.5) / (0.25 * sqrt(0.5)), 2) / 2) / sqrt(2 * pi()) / (75.0 * 0.25 * sqrt(0.5)) AS base FROM lots)
SELECT trade_date, ROUND(SUM(up * lots) - SUM(base * lots), 6) AS vol_sensitivity FROM d2 GROUP BY 1""")
def gamma_vol_sensitivity(spark, sf):
    return rounded(O.vol_sensitivity(chain(spark, sf)), "vol_sensitivity")


def _net_at(shift):
    spot = f"(75.0 + 75.0 * 0.25 * sqrt(0.5) * {shift})"
    d1 = f"((ln({spot} / strike) + 0.5 * 0.25 * 0.25 * 0.5) / (0.25 * sqrt(0.5)))"
    return f"SUM(exp(-{d1} * {d1} / 2) / sqrt(2 * pi()) / ({spot} * 0.25 * sqrt(0.5)) * lots)"


@query("gamma_convexity", f"""WITH {_TERRAIN}, c AS (SELECT trade_date, {_net_at(0)} AS a, ({_net_at(1)} + {_net_at(-1)}) / 2 AS g1,
  ({_net_at(2)} + {_net_at(-2)}) / 2 AS g2, COUNT(DISTINCT strike) AS n_strikes FROM lots GROUP BY 1)
SELECT trade_date, ROUND(a, 6) AS atm_gamma, ROUND(g1, 6) AS g_1sigma, ROUND(g2, 6) AS g_2sigma, n_strikes,
  ROUND(g1 - g2, 6) AS sigma_1_2_spread, n_strikes < 20 AS is_thin FROM c""")
def gamma_convexity(spark, sf):
    c = chain(spark, sf)
    atm = c.groupBy("trade_date").agg((F.max("vol") * F.max("forward") * F.sqrt(F.max("years"))).alias("sigma"))
    return rounded(O.convexity(c, atm), "atm_gamma", "g_1sigma", "g_2sigma", "sigma_1_2_spread")


# ---------------------------------------------------------------- documents

@query("document_search", """SELECT doc_id, CAST(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) AS DATE) AS issue_date, lang, source FROM documents
WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'the')
  AND DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) <= DATE '2023-06-30'""")
def document_search(spark, sf):
    docs = table(spark, sf, "documents").withColumn(
        "issue_date", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")))
    hits = D.search(docs, "text", "issue_date", term="the", end="2023-06-30")
    return hits.select("doc_id", "issue_date", "lang", "source")


def _dated(spark, sf):
    return table(spark, sf, "documents").withColumn(
        "issue_date", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")))


@query("indexed_document_search", """SELECT doc_id, CAST(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) AS DATE) AS issue_date, lang, source FROM documents
WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'of')
  AND DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) >= DATE '2020-02-01'""")
def indexed_document_search(spark, sf):
    """An index of all words of all texts is written, then searched for two of them."""
    docs, path = _dated(spark, sf), shared_folder(spark)
    X.build(docs, "doc_id", "text", path)
    hits = X.indexed_search(docs, path, "doc_id", "text", "issue_date", term="Of the", start="2020-02-01")
    return hits.select("doc_id", "issue_date", "lang", "source")


@query("word_document_counts", """SELECT word, COUNT(*) AS documents FROM (SELECT DISTINCT doc_id, word FROM (
  SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents)) WHERE word <> '' GROUP BY 1""")
def word_document_counts(spark, sf):
    """The document frequency of every word, as the index keeps it."""
    path = shared_folder(spark)
    X.build(table(spark, sf, "documents"), "doc_id", "text", path)
    return spark.read.schema("word string, documents long").parquet(f"{path}/words").select("word", "documents")
