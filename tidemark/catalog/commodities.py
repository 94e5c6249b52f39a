"""Two commodities in one plan: the second one's rows are the first one's with codes of its own and volumes that vary by date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import boundaries as bnd
from tidemark.catalog import options as opt
from tidemark.catalog.adapters import TAPE_SQL, TIER_COLUMNS_SQL, rounded, sidecar, tape, tiers_sql
from tidemark.catalog.bars import seed
from tidemark.catalog.registry import query
from tidemark.plans import futures as fut
from tidemark.plans import options as P
from tidemark.settings import COTTON, Market

SUGAR = Market(prefix="SB", excluded_prefixes=("SBV", "SBQ"), excluded_generics=("SBOCT", "SBAUG"),
                serial_parents=(("SBU", "SBZ"), ("SBX", "SBZ"), ("SBF", "SBH")))
BOTH = (COTTON, SUGAR)
_FACTOR = "(1 + day(session_date) % 3)"
_OF = "FROM (SELECT *, 'CT' AS commodity, 1 AS f FROM {0} UNION ALL SELECT *, 'SB', " + _FACTOR + " FROM {0}) q"


def _both(df, code, *volumes):
    """Rows of both commodities; codes that begin with the prefix get the other one's."""
    factor = 1 + F.dayofmonth("session_date") % 3
    second = df.withColumn(code, F.regexp_replace(code, "^CT", "SB")).withColumns({v: F.col(v) * factor for v in volumes})
    return df.withColumn("commodity", F.lit("CT")).unionByName(second.withColumn("commodity", F.lit("SB")))


def options_run(spark, sf, **kw):
    return P.options_sessions(_both(tape(spark, sf), "contract", "call_vol", "put_vol"), generated_at=opt.AT, market=BOTH, **kw)


def futures_run(spark, sf, **kw):
    return fut.futures_sessions(_both(sidecar(spark, sf), "contract", "volume"), _both(seed(spark, sf), "generic", "volume"),
                                generated_at=bnd.AT, market=BOTH, **kw)


_TWO = f"""two AS (SELECT commodity, session_date, win, call * f AS call, put * f AS put, total * f AS total,
  snapshot_ts_start, snapshot_ts {_OF.format('totals')})"""


@query("two_commodity_option_totals", f"""WITH {TAPE_SQL}, {_TWO} SELECT commodity, session_date, win AS "window", total, call, put,
  ROUND(put / NULLIF(call, 0), 6) AS pc_ratio, snapshot_ts_start, snapshot_ts FROM two""")
def two_commodity_option_totals(spark, sf):
    return rounded(options_run(spark, sf).totals, "pc_ratio")


@query("two_commodity_option_rvol", f"""WITH {TAPE_SQL}, {_TWO}, {tiers_sql('two', 'commodity, win', 'session_date', 'total')}
SELECT commodity, session_date, win AS "window", total, {TIER_COLUMNS_SQL} FROM tiers""")
def two_commodity_option_rvol(spark, sf):
    out = options_run(spark, sf).rvol.select("commodity", "session_date", "window", "total", "tier", "avg", "rvol", "n", "note", "flag")
    return rounded(out, "avg", "rvol")


@query("two_commodity_futures_totals", f"""WITH {bnd._BOTH} SELECT commodity, session_date, source, night * f AS night, day * f AS day,
  full_volume * f AS "full", n_contracts, ROUND(night / NULLIF(full_volume, 0), 6) AS night_share,
  ROUND(night / NULLIF(day, 0), 6) AS night_day_ratio {_OF.format('ftotals')}""")
def two_commodity_futures_totals(spark, sf):
    return rounded(futures_run(spark, sf).totals, "night_share", "night_day_ratio")


@query("two_commodity_futures_rvol", f"""WITH {bnd._BOTH},
cur AS (SELECT commodity, session_date, m.metric, CASE m.metric WHEN 'night' THEN night WHEN 'day' THEN day ELSE full_volume END * f AS value
  FROM (SELECT * {_OF.format('ftotals')}) t CROSS JOIN (VALUES ('night'), ('day'), ('full')) m(metric)),
prior AS (SELECT commodity, session_date, metric, value FROM cur WHERE metric <> 'full' AND value IS NOT NULL
  UNION ALL SELECT commodity, session_date, 'full', full_volume * f {_OF.format('seed_total')}),
ord AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY commodity, metric ORDER BY session_date) AS k FROM prior),
last AS (SELECT c.commodity, c.session_date, c.metric, c.value, MAX(o.k) AS k FROM cur c LEFT JOIN ord o
  ON o.commodity = c.commodity AND o.metric = c.metric AND o.session_date < c.session_date GROUP BY 1, 2, 3, 4),
tiers AS (SELECT l.commodity, l.session_date, l.metric, l.value, t.tier, AVG(o.value) AS raw, COUNT(o.value) AS n
  FROM last l CROSS JOIN (VALUES (5), (10), (20), (30), (60)) t(tier) LEFT JOIN ord o
  ON o.commodity = l.commodity AND o.metric = l.metric AND o.k <= l.k AND o.k > l.k - t.tier GROUP BY 1, 2, 3, 4, 5)
SELECT commodity, session_date, metric, value, tier, n, ROUND(CASE WHEN value IS NOT NULL THEN raw END, 6) AS avg,
  ROUND(value / NULLIF(raw, 0), 6) AS rvol FROM tiers""")
def two_commodity_futures_rvol(spark, sf):
    out = futures_run(spark, sf).rvol.select("commodity", "session_date", "metric", "value", "tier", "n", "avg", "rvol")
    return rounded(out, "avg", "rvol")
