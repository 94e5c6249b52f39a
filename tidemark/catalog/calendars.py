"""The exchange calendar of any year: holidays by rule and business-day shifts of the order dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.adapters import table
from tidemark.catalog.registry import query
from tidemark.functions.calendar import plus_business_days, trading_calendar
from tidemark.functions.sessions import is_closed, is_holiday, next_business_day
from tidemark.settings import US_EXCHANGE, Market

RULED = Market(closed_dates=(), holiday_rules=US_EXCHANGE)

# The rules once more, as SQL over a table ``y`` of years: nth weekdays from the first of the month, Easter by its epact.
CALENDAR_SQL = """
y AS (SELECT UNNEST(generate_series(CAST((SELECT MIN(year(o_orderdate)) FROM orders) AS BIGINT) - 1,
    CAST((SELECT MAX(year(o_orderdate)) FROM orders) AS BIGINT) + 1)) AS y),
e AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS d FROM e4),
fixed AS (SELECT make_date(y, 1, 1) AS d, false AS sat FROM y UNION ALL SELECT make_date(y, 6, 19), true FROM y WHERE y >= 2022
  UNION ALL SELECT make_date(y, 7, 4), true FROM y UNION ALL SELECT make_date(y, 12, 25), true FROM y),
nth AS (SELECT make_date(y, 1, 1) AS f, 1 AS wd, 3 AS n FROM y WHERE y >= 1998 UNION ALL SELECT make_date(y, 2, 1), 1, 3 FROM y
  UNION ALL SELECT make_date(y, 9, 1), 1, 1 FROM y UNION ALL SELECT make_date(y, 11, 1), 4, 4 FROM y),
h AS (SELECT d + CASE WHEN isodow(d) = 7 THEN 1 WHEN isodow(d) = 6 AND sat THEN -1 ELSE 0 END AS d FROM fixed
  UNION ALL SELECT f + CAST((wd - isodow(f) + 7) % 7 + 7 * (n - 1) AS INTEGER) FROM nth
  UNION ALL SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) FROM y
  UNION ALL SELECT d - 2 FROM easter),
days AS (SELECT CAST(UNNEST(generate_series((SELECT make_date(MIN(y), 1, 1) FROM y), (SELECT make_date(MAX(y), 12, 31) FROM y), INTERVAL 1 DAY)) AS DATE) AS d),
cal AS (SELECT d, d IN (SELECT CAST(d AS DATE) FROM h) AS is_holiday FROM days),
o AS (SELECT *, isodow(d) < 6 AND NOT is_holiday AS is_open FROM cal),
n AS (SELECT *, SUM(CAST(is_open AS INTEGER)) OVER (ORDER BY d) AS ordinal FROM o)"""


@query("settlement_calendar", f"""WITH {CALENDAR_SQL}, c AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS orders FROM orders GROUP BY 1)
SELECT c.day, c.orders, n.is_holiday, NOT n.is_open AS is_closed, t1.d AS next_open, t1.d AS release_date, t2.d AS settles
FROM c JOIN n ON n.d = c.day JOIN n t1 ON t1.is_open AND t1.ordinal = n.ordinal + 1 JOIN n t2 ON t2.is_open AND t2.ordinal = n.ordinal + 2""")
def settlement_calendar(spark, sf):
    """Order dates with their place in the exchange's calendar: next open day by expression and by ordinal, settlement at T+2."""
    day = F.col("day")
    days = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("orders"))
    years = days.agg(F.year(F.min("day")), F.year(F.max("day"))).first()
    if years[0] is None:
        years = (2000, 2000)
    calendar = trading_calendar(spark, years[0] - 1, years[1] + 1, RULED)
    shifted = plus_business_days(days, "day", {"release_date": 1, "settles": 2}, calendar)
    return shifted.select("day", "orders", is_holiday(day, RULED).alias("is_holiday"), is_closed(day, RULED).alias("is_closed"),
                          next_business_day(day, RULED).alias("next_open"), "release_date", "settles")
