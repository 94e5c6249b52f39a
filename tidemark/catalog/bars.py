"""Queries over daily bars: symbology, totals, trailing comparison, ingest, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import (BARS_SQL, TIER_COLUMNS_SQL, bars, pick, rounded, table, tiers_sql)
from tidemark.catalog.registry import query
from tidemark.functions import symbology as S
from tidemark.functions.parsing import number_or_null, number_or_zero
from tidemark.operators import boundary as B
from tidemark.operators import coverage as C
from tidemark.operators import trailing as R
from tidemark.operators.ranking import last_sessions, rank_contracts
from tidemark.operators.sizing import shared_folder
from tidemark.operators.upsert import upsert
from tidemark.plans import futures as P
from tidemark.plans import history as H
from tidemark.sources.market import clean_bars, flatten_history
from tidemark.sources.sinks import HistoryTable

TIER_COLUMNS = ("tier", "avg", "rvol", "n", "note", "flag")


def seed(spark, sf):
    return clean_bars(bars(spark, sf))


def _tiers(df, *keys):
    return rounded(df.select(*keys, *TIER_COLUMNS), "avg", "rvol")


def _commodity_totals(spark, sf):
    """Full volume by commodity, which is the prefix of the generics, and session."""
    named = seed(spark, sf).withColumn("commodity", F.substring("generic", 1, 2))
    return P.seed_totals(named).withColumnRenamed("full", "full_volume")


@query("seed_session_rvol", f"""WITH {BARS_SQL}, {tiers_sql('seed_total', '', 'session_date', 'full_volume')}
SELECT session_date, full_volume, {TIER_COLUMNS_SQL} FROM tiers""")
def seed_session_rvol(spark, sf):
    return _tiers(R.trailing(_commodity_totals(spark, sf), ["commodity"], "session_date", "full_volume"), "session_date", "full_volume")


@query("seed_bars_clean", f"WITH {BARS_SQL} SELECT session_date, generic, volume FROM seed")
def seed_bars_clean(spark, sf):
    return seed(spark, sf)


@query("seed_session_totals", f"WITH {BARS_SQL} SELECT session_date, full_volume FROM seed_total")
def seed_session_totals(spark, sf):
    return P.seed_totals(seed(spark, sf)).withColumnRenamed("full", "full_volume")


@query("raw_bar_totals", f"WITH {BARS_SQL} SELECT session_date, SUM(volume) AS full_volume FROM bars GROUP BY 1")
def raw_bar_totals(spark, sf):
    return P.seed_totals(bars(spark, sf)).withColumnRenamed("full", "full_volume")


@query("seed_contract_rvol", f"""WITH {BARS_SQL}, {tiers_sql('seed', 'generic', 'session_date', 'volume')}
SELECT generic, session_date, volume, {TIER_COLUMNS_SQL} FROM tiers""")
def seed_contract_rvol(spark, sf):
    return _tiers(R.trailing(seed(spark, sf), ["generic"], "session_date", "volume"),
                  "generic", "session_date", "volume")


@query("seed_rvol_strict", f"""WITH {BARS_SQL}, {tiers_sql('seed_total', '', 'session_date', 'full_volume')}
SELECT session_date, full_volume, tier AS lookback, n >= tier AS available, n AS have, tier AS need,
  CASE WHEN n >= tier THEN ROUND(avg_volume, 6) END AS avg,
  CASE WHEN n >= tier THEN ROUND(rvol, 6) END AS rvol,
  CASE WHEN n < tier THEN NULL WHEN rvol >= 2.0 THEN 'HIGH' WHEN rvol <= 0.5 THEN 'LOW' END AS flag
FROM tiers""")
def seed_rvol_strict(spark, sf):
    out = R.trailing(_commodity_totals(spark, sf), ["commodity"], "session_date", "full_volume", mode="strict")
    return rounded(out, "avg", "rvol").select(
        "session_date", "full_volume", F.col("tier").alias("lookback"), "available", F.col("n").alias("have"),
        F.col("tier").alias("need"), "avg", "rvol", "flag")


@query("seed_previous_session", f"""WITH {BARS_SQL}, p AS (
  SELECT session_date, full_volume, LAG(full_volume) OVER (ORDER BY session_date) AS prev FROM seed_total)
SELECT session_date, full_volume, prev, ROUND((full_volume / NULLIF(prev, 0) - 1) * 100, 6) AS change_pct,
  CASE WHEN prev IS NULL THEN NULL WHEN COALESCE(full_volume / NULLIF(prev, 0) - 1, 0) >= 0 THEN 'UP' ELSE 'DOWN' END
    AS direction FROM p""")
def seed_previous_session(spark, sf):
    out = R.previous_session(_commodity_totals(spark, sf), ["commodity"], "session_date", "full_volume")
    return rounded(out.drop("commodity"), "change_pct")


def board_totals(spark, sf):
    """Session volume of four commodities."""
    com = pick(F.col("l_suppkey") % 4, "CT", "KC", "CC", "SB")
    return table(spark, sf, "lineitem").groupBy(com.alias("commodity"), F.col("l_shipdate").cast("date").alias("session_date")) \
        .agg(F.sum("l_quantity").cast("double").alias("full_volume"))


_BOARD_SQL = """
board_total AS (SELECT CASE l_suppkey % 4 WHEN 0 THEN 'CT' WHEN 1 THEN 'KC' WHEN 2 THEN 'CC' ELSE 'SB' END AS commodity,
    CAST(l_shipdate AS DATE) AS session_date, CAST(SUM(l_quantity) AS DOUBLE) AS full_volume FROM lineitem GROUP BY 1, 2)"""


@query("commodity_session_rvol", f"""WITH {_BOARD_SQL}, {tiers_sql('board_total', 'commodity', 'session_date', 'full_volume')}
SELECT commodity, session_date, full_volume, {TIER_COLUMNS_SQL} FROM tiers""")
def commodity_session_rvol(spark, sf):
    """Every session of every commodity against its own trailing sessions: one window partition each."""
    return _tiers(R.trailing(board_totals(spark, sf), ["commodity"], "session_date", "full_volume"),
                  "commodity", "session_date", "full_volume")


@query("commodity_previous_session", f"""WITH {_BOARD_SQL}, p AS (
  SELECT *, LAG(full_volume) OVER (PARTITION BY commodity ORDER BY session_date) AS prev FROM board_total)
SELECT commodity, session_date, full_volume, prev, ROUND((full_volume / NULLIF(prev, 0) - 1) * 100, 6) AS change_pct,
  CASE WHEN prev IS NULL THEN NULL WHEN COALESCE(full_volume / NULLIF(prev, 0) - 1, 0) >= 0 THEN 'UP' ELSE 'DOWN' END
    AS direction FROM p""")
def commodity_previous_session(spark, sf):
    return rounded(R.previous_session(board_totals(spark, sf), ["commodity"], "session_date", "full_volume"), "change_pct")


@query("seed_prior_values", f"""WITH {BARS_SQL}, w AS (
  SELECT generic, session_date, LAG(volume, 1) OVER o AS p1, LAG(volume, 2) OVER o AS p2, LAG(volume, 3) OVER o AS p3
  FROM seed WINDOW o AS (PARTITION BY generic ORDER BY session_date))
SELECT generic, session_date, concat_ws(',', CAST(CAST(p1 AS BIGINT) AS VARCHAR), CAST(CAST(p2 AS BIGINT) AS VARCHAR),
  CAST(CAST(p3 AS BIGINT) AS VARCHAR)) AS priors FROM w""")
def seed_prior_values(spark, sf):
    out = R.prior_values(seed(spark, sf), ["generic"], "session_date", "volume", 3)
    text = F.array_join(F.transform("priors", lambda v: v.cast("bigint").cast("string")), ",")
    return out.withColumn("priors", text)


_NAMED = """session_date, generic AS generic_code, 'CT' || letter || CAST(dyear % 10 AS VARCHAR) AS ice_code,
  letter AS month_code, mname AS month_name, dyear AS delivery_year, pos AS position"""


@query("generic_resolution", f"WITH {BARS_SQL} SELECT {_NAMED}, mnum AS month_num FROM seed_named")
def generic_resolution(spark, sf):
    info = S.resolve_generic(F.col("generic"), F.col("session_date")).alias("i")
    return seed(spark, sf).select("session_date", info).select(
        "session_date", "i.generic_code", "i.ice_code", "i.month_code", "i.month_name", "i.delivery_year",
        "i.position", "i.month_num")


@query("session_universe", f"""WITH {BARS_SQL}, d AS (SELECT DISTINCT session_date FROM bars), seed2 AS (
  SELECT d.session_date, n.generic, n.letter, n.mname, n.pos, n.mnum, CAST(year(d.session_date)
    + CASE WHEN make_date(year(d.session_date), n.mnum, 1) >= d.session_date THEN 0 ELSE 1 END + n.pos - 1 AS INTEGER) AS dyear
  FROM d CROSS JOIN named n)
SELECT {_NAMED}, mnum AS month_num, 'CT' AS prefix FROM seed2""")
def session_universe(spark, sf):
    days = bars(spark, sf).select("session_date").distinct()
    return S.universe(days)


@query("exchange_code_positions", f"""WITH {BARS_SQL}, d AS (SELECT DISTINCT session_date, generic FROM bars),
codes AS (SELECT session_date, ' ct' || CASE generic WHEN 'CTMAR1' THEN 'h' WHEN 'CTMAR2' THEN 'k' WHEN 'CTMAY1' THEN 'n'
    WHEN 'CTMAY2' THEN 'z' WHEN 'CTJUL1' THEN 'v' WHEN 'CTJUL2' THEN 'q' WHEN 'CTDEC1' THEN 'f' WHEN 'CTDEC2' THEN 'u'
    WHEN 'CTOCT1' THEN 'x' ELSE 'a' END || CAST(day(session_date) % 10 AS VARCHAR) || ' ' AS code FROM d),
parts AS (SELECT session_date, code, upper(trim(code)) AS body, substr(upper(trim(code)), 3, 1) AS letter,
    CAST(right(trim(code), 1) AS INTEGER) AS digit, year(session_date) AS y FROM codes),
nums AS (SELECT *, CASE letter WHEN 'F' THEN 1 WHEN 'H' THEN 3 WHEN 'K' THEN 5 WHEN 'N' THEN 7 WHEN 'Q' THEN 8
    WHEN 'U' THEN 9 WHEN 'V' THEN 10 WHEN 'X' THEN 11 WHEN 'Z' THEN 12 END AS m FROM parts),
years AS (SELECT *, CASE WHEN m IS NOT NULL THEN
    (SELECT MIN(c) FROM (SELECT unnest(range(y - 1, y + 9)) AS c) r WHERE c % 10 = digit) END AS dy FROM nums),
pos AS (SELECT *, dy - (y + CASE WHEN make_date(y, m, 1) >= session_date THEN 0 ELSE 1 END) + 1 AS p FROM years)
SELECT session_date, code, CASE WHEN m IS NOT NULL THEN letter END AS month_code, CAST(dy AS INTEGER) AS delivery_year,
  CAST(p AS INTEGER) AS position, p IN (1, 2) AND letter IN ('H','K','N','Z') IS TRUE AS in_universe,
  CASE WHEN p IN (1, 2) AND letter IN ('H','K','N','Z') THEN 'CT' || CASE letter WHEN 'H' THEN 'MAR' WHEN 'K' THEN 'MAY'
    WHEN 'N' THEN 'JUL' ELSE 'DEC' END || CAST(p AS VARCHAR) END AS generic_code,
  CASE WHEN letter IN ('U','X','Z') THEN 'CTZ' WHEN letter IN ('F','H') THEN 'CTH' WHEN letter IN ('K','N') THEN 'CT' || letter
    END AS parent FROM pos""")
def exchange_code_positions(spark, sf):
    """Codes of every kind (tracked, serial, excluded, invalid) on every bar date."""
    letters = dict(zip(("CTMAR1", "CTMAR2", "CTMAY1", "CTMAY2", "CTJUL1", "CTJUL2", "CTDEC1", "CTDEC2", "CTOCT1",
                        "CTAUG1"), "hknzvqfuxa"))
    letter = F.element_at(F.create_map(*[F.lit(x) for kv in letters.items() for x in kv]), F.col("generic"))
    digit = (F.dayofmonth("session_date") % 10).cast("string")
    codes = bars(spark, sf).select("session_date", F.concat(F.lit(" ct"), letter, digit, F.lit(" ")).alias("code"))
    code, day = F.col("code"), F.col("session_date")
    parts = S.exchange_parts(code, day)
    slot = S.generic_of_exchange(code, day)
    return codes.select(
        "session_date", "code", parts["month_code"].alias("month_code"),
        parts["delivery_year"].alias("delivery_year"), S.exchange_position(code, day).alias("position"),
        slot.isNotNull().alias("in_universe"), slot.alias("generic_code"), S.parent_prefix(code).alias("parent"))


_INGEST = f"""WITH {BARS_SQL}"""


@query("seed_ingest_sessions", f"""{_INGEST} SELECT session_date AS date, 'CT' AS commodity, CAST(NULL AS DOUBLE) AS night_total,
  CAST(NULL AS DOUBLE) AS day_total, full_volume AS full_total, CAST(NULL AS DOUBLE) AS night_share,
  CAST(NULL AS DOUBLE) AS night_day_ratio, 'seed' AS source, '' AS split_source FROM seed_total""")
def seed_ingest_sessions(spark, sf):
    return P.seed_ingest(seed(spark, sf))[0].drop("generated_at")


@query("seed_ingest_contracts", f"""{_INGEST} SELECT session_date AS date, 'CT' AS commodity, generic AS generic_code,
  'CT' || letter || CAST(dyear % 10 AS VARCHAR) AS ice_code, letter AS month_code, mname AS month_name,
  dyear AS delivery_year, pos AS position, CAST(NULL AS DOUBLE) AS night, CAST(NULL AS DOUBLE) AS day,
  volume AS "full" FROM seed_named""")
def seed_ingest_contracts(spark, sf):
    return P.seed_ingest(seed(spark, sf))[1].drop("generated_at")


@query("seed_coverage", f"""WITH {BARS_SQL} SELECT MIN(session_date) AS first_date, MAX(session_date) AS last_date,
  COUNT(DISTINCT session_date) AS n_dates FROM bars""")
def seed_coverage(spark, sf):
    return C.coverage(bars(spark, sf))


@query("seed_nonzero_days", f"WITH {BARS_SQL} SELECT generic, COUNT(*) FILTER (volume <> 0) AS n_days FROM bars GROUP BY 1")
def seed_nonzero_days(spark, sf):
    return C.nonzero_days(bars(spark, sf))


@query("bars_from_nested_response", f"""WITH {BARS_SQL} SELECT session_date, generic, generic || ' future' AS ticker, volume,
  open_int, px_last, CAST(NULL AS DOUBLE) AS efp_volume FROM bars""")
def bars_from_nested_response(spark, sf):
    """Bars nested per security and year (at most 366 entries each), then flattened."""
    rec = F.struct(F.col("session_date").alias("date"), F.col("volume").alias("day_volume"),
                   F.col("open_int"), F.col("px_last"))
    nested = bars(spark, sf).groupBy(F.concat("generic", F.lit(" future")).alias("security"),
                                     F.year("session_date").alias("y")).agg(F.collect_list(rec).alias("fieldData"))
    return flatten_history(nested, {"volume": "day_volume"}, " future").select("session_date", "generic", "ticker", "volume", "open_int", "px_last",
                                          "efp_volume")


def _refresh_day():
    return F.lit("2001-06-30").cast("date")


_REPULL = f"""WITH {BARS_SQL}, newer AS (
  SELECT session_date, generic, volume + 1 AS volume FROM seed
  WHERE session_date BETWEEN DATE '2001-06-15' AND DATE '2001-06-30'),
merged AS (SELECT s.session_date, s.generic, COALESCE(n.volume, s.volume) AS volume
  FROM seed s LEFT JOIN newer n ON n.session_date = s.session_date AND n.generic = s.generic)"""


def _repulled(spark, sf):
    return seed(spark, sf).withColumn("volume", F.col("volume") + 1)


@query("trailing_refresh_bars", f"{_REPULL} SELECT session_date, generic, volume FROM merged")
def trailing_refresh_bars(spark, sf):
    return P.refresh_bars(seed(spark, sf), _repulled(spark, sf), _refresh_day(), 15)


@query("trailing_refresh_counts", f"""{_REPULL} SELECT (SELECT COUNT(*) FROM newer) AS n_new,
  (SELECT COUNT(*) FROM seed) - (SELECT COUNT(*) FROM newer) AS n_kept, (SELECT COUNT(*) FROM merged) AS n_total""")
def trailing_refresh_counts(spark, sf):
    day = _refresh_day()
    recent = _repulled(spark, sf).filter(
        (F.col("session_date") >= F.date_sub(day, 15)) & (F.col("session_date") <= day))
    table = HistoryTable(spark, shared_folder(spark), "session_date date, generic string, volume double", ("session_date", "generic"), date="session_date")
    table.upsert(seed(spark, sf))
    counts = table.upsert(recent)  # counted by the write itself
    return spark.createDataFrame([tuple(counts.values())], "n_new long, n_kept long, n_total long")


@query("last_seed_sessions", f"""WITH {BARS_SQL} SELECT session_date FROM seed_total ORDER BY session_date DESC LIMIT 5""")
def last_seed_sessions(spark, sf):
    return last_sessions(seed(spark, sf), 5)


@query("seed_contract_rank", f"""WITH {BARS_SQL} SELECT session_date, generic, volume, ROW_NUMBER() OVER (
  PARTITION BY session_date ORDER BY volume DESC, generic) AS rank FROM seed WHERE volume > 0""")
def seed_contract_rank(spark, sf):
    return rank_contracts(seed(spark, sf), ["session_date"], "volume", "generic")


@query("generic_volume_history", f"""WITH {BARS_SQL} SELECT b.session_date, b.generic, b.volume, b.open_int,
  'CTZ' || CAST(n.dyear % 10 AS VARCHAR) AS ice_code, n.dyear AS delivery_year FROM bars b JOIN seed_named n
  ON n.session_date = b.session_date AND n.generic = b.generic
  WHERE b.generic = 'CTDEC1' AND b.session_date >= DATE '1996-01-01'""")
def generic_volume_history(spark, sf):
    return H.generic_history(bars(spark, sf), "CTDEC1", start="1996-01-01",
                             fields=("session_date", "generic", "volume", "open_int", "ice_code", "delivery_year"))


@query("december_over_years", f"""WITH {BARS_SQL} SELECT pos AS position, dyear AS delivery_year, COUNT(*) AS n_sessions,
  SUM(volume) AS volume, MAX(volume) AS peak, MIN(session_date) AS first_date, MAX(session_date) AS last_date
  FROM seed_named WHERE letter = 'Z' GROUP BY 1, 2""")
def december_over_years(spark, sf):
    contracts = B.contract_rows(B.seed_slots(seed(spark, sf)))
    return H.month_over_years(contracts, "Z")


@query("volume_with_open_interest", f"""WITH {BARS_SQL} SELECT s.session_date, s.generic AS generic_code, s.volume,
  b.open_int, b.px_last AS settle FROM seed s JOIN bars b ON b.session_date = s.session_date AND b.generic = s.generic""")
def volume_with_open_interest(spark, sf):
    daily = bars(spark, sf)
    interest = daily.select(F.col("session_date").alias("date"), F.col("generic").alias("contract"), "open_int",
                            F.col("px_last").alias("settle"))
    return H.with_open_interest(seed(spark, sf).withColumnRenamed("generic", "generic_code"), interest)


_FLAT = """lineitem_days AS (
  SELECT CAST(l_shipdate AS DATE) AS session_date,
    CASE l_partkey % 10 WHEN 0 THEN 'CTMAR1' WHEN 1 THEN 'CTMAR2' WHEN 2 THEN 'CTMAY1' WHEN 3 THEN 'CTMAY2'
      WHEN 4 THEN 'CTJUL1' WHEN 5 THEN 'CTJUL2' WHEN 6 THEN 'CTDEC1' WHEN 7 THEN 'CTDEC2'
      WHEN 8 THEN 'CTOCT1' ELSE 'CTAUG1' END AS generic_code,
    SUM(l_quantity) FILTER (l_returnflag <> 'R') AS a, SUM(l_quantity) FILTER (l_linenumber <> 7) AS b
  FROM lineitem GROUP BY 1, 2)"""


@query("source_reconciliation", f"""WITH {_FLAT}, g AS (SELECT session_date, generic_code, a AS left_volume, b AS right_volume,
  a - b AS gap, (a - b) / NULLIF(b, 0) * 100 AS pct FROM lineitem_days WHERE a IS NOT NULL OR b IS NOT NULL)
SELECT session_date, generic_code, left_volume, right_volume, gap, ROUND(pct, 6) AS gap_pct,
  CASE WHEN left_volume IS NULL THEN 'right only' WHEN right_volume IS NULL THEN 'left only'
    WHEN abs(pct) > 5.0 THEN 'outlier' WHEN gap = 0 THEN 'equal' ELSE 'close' END AS state FROM g""")
def source_reconciliation(spark, sf):
    """Two partial views of the same bars, compared per date and slot."""
    from tidemark.catalog.adapters import GENERICS

    def source(keep):
        return table(spark, sf, "lineitem").filter(keep).groupBy(
            F.col("l_shipdate").cast("date").alias("session_date"),
            pick(F.col("l_partkey") % 10, *GENERICS).alias("generic_code")).agg(F.sum("l_quantity").alias("volume"))

    out = C.reconcile(source(F.col("l_returnflag") != "R"), source(F.col("l_linenumber") != 7))
    return rounded(out, "gap_pct")


_FORMS = """CASE WHEN o_orderstatus = 'O' THEN CAST(CAST(o_orderkey AS BIGINT) AS VARCHAR)
  WHEN o_orderstatus = 'F' THEN split_part(o_orderpriority, '-', 1) ELSE o_orderpriority END"""


@query("number_parsing", f"""SELECT o_orderkey, COALESCE(TRY_CAST(t AS DOUBLE), 0.0) AS zero_form,
  TRY_CAST(t AS DOUBLE) AS null_form FROM (SELECT o_orderkey, {_FORMS} AS t FROM orders) x""")
def number_parsing(spark, sf):
    """The two numeric parsers on digits, priority ranks and text that is no number."""
    text = F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey").cast("string")) \
        .when(F.col("o_orderstatus") == "F", F.split_part("o_orderpriority", F.lit("-"), F.lit(1))) \
        .otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(
        "o_orderkey", number_or_zero(text).alias("zero_form"), number_or_null(text).alias("null_form"))


@query("keyed_upsert_coalesce", f"""WITH {BARS_SQL}, o AS (SELECT session_date, generic, volume, open_int FROM bars
  WHERE generic LIKE 'CT___1'), n AS (SELECT session_date, generic, CASE WHEN volume >= 20 THEN volume * 2 END AS volume
  FROM bars WHERE generic LIKE 'CTDEC_')
SELECT COALESCE(o.session_date, n.session_date) AS session_date, COALESCE(o.generic, n.generic) AS generic,
  COALESCE(n.volume, o.volume) AS volume, o.open_int FROM o FULL OUTER JOIN n
  ON o.session_date = n.session_date AND o.generic = n.generic""")
def keyed_upsert_coalesce(spark, sf):
    """Upsert that keeps old values where the new ones are blank."""
    daily = bars(spark, sf)
    old = daily.filter(F.col("generic").endswith("1")).select("session_date", "generic", "volume", "open_int")
    new = daily.filter(F.col("generic").startswith("CTDEC")).select(
        "session_date", "generic", F.when(F.col("volume") >= 20, F.col("volume") * 2).alias("volume"))
    return upsert(old, new, ["session_date", "generic"], merge="coalesce")
