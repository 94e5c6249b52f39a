"""Open interest: change, release alignment, calendar-spread chain, positioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.datasets.slices import COMMODITIES, check_choice, where
from tidemark.functions.parsing import ratio
from tidemark.functions.sessions import next_business_day
from tidemark.functions.symbology import computed, resolve_generic
from tidemark.settings import COTTON, Market


def options_history(options: DataFrame, commodity: str | None = None, start: str | None = None,
                    end: str | None = None, month: str | None = None, strike: float | None = None,
                    pc: str | None = None) -> DataFrame:
    """Options open interest with any combination of filters."""
    return where(options, "date", start, end, commodity=check_choice(commodity, COMMODITIES, "commodity"),
                 contract_month=month, strike_px=strike, put_call=check_choice(pc, ("C", "P"), "put/call"))


def change(df: DataFrame, keys: Sequence[str], date: str, value: str, name: str) -> DataFrame:
    """Difference to the previous row of the same key, blank on the first."""
    order = Window.partitionBy(*keys).orderBy(date)
    return df.withColumn(name, F.col(value) - F.lag(value, 1).over(order))


def align_release(options: DataFrame, futures: DataFrame, market: Market = COTTON) -> DataFrame:
    """Option rows, dated by release one business day late, with the future they settle into.

    Matches commodity, delivery month and the trade date before the release; a board has one
    contract per delivery month, so every option row meets at most one future.
    """
    info = resolve_generic(F.col("contract"), F.col("date"))
    month = F.concat(info["month_name"], F.lit(" "), info["delivery_year"].cast("string"))
    traded = computed(futures, release_date=next_business_day(F.col("date"), market), contract_month=month) \
        .withColumnRenamed("date", "trade_date")
    return options.withColumnRenamed("date", "release_date").join(
        traded, ["commodity", "release_date", "contract_month"])


def spread_chain(futures: DataFrame, skipped: Sequence[str] = ("OCT",), pairs: int | None = None) -> DataFrame:
    """Front minus back settlement of neighbouring deliveries: labels 1-2, 2-3, ..., all or the first ``pairs``.

    One (date, commodity) holds a board of at most a dozen contracts.
    """
    info = resolve_generic(F.col("contract"), F.col("date"))
    word = F.substring(F.rtrim("contract", F.lit("0123456789")), -3, 3)
    board = computed(futures, delivery=info["delivery_year"] * 100 + info["month_num"], word=word).filter(
        F.col("delivery").isNotNull() & ~F.col("word").isin(*skipped))
    order = Window.partitionBy("date", "commodity").orderBy("delivery")
    chained = board.select(
        "date", "commodity", "contract", F.row_number().over(order).alias("position"),
        F.lead("contract").over(order).alias("back"),
        (F.col("settle") - F.lead("settle").over(order)).alias("settle"))
    label = F.concat(F.col("position").cast("string"), F.lit("-"), (F.col("position") + 1).cast("string"))
    wanted = F.col("back").isNotNull() if pairs is None else F.col("back").isNotNull() & (F.col("position") <= pairs)
    return chained.filter(wanted).select(
        "date", "commodity", label.alias("spread_label"), F.col("contract").alias("front"), "back", "settle")


def positioning(reports: DataFrame) -> DataFrame:
    """Net position per participant, week-on-week changes and net as a share of open interest."""
    order = Window.partitionBy("participant").orderBy("report_date")
    net = reports.withColumn("net", F.col("long") - F.col("short"))
    changes = [(F.col(c) - F.lag(c).over(order)).alias(f"chg_{c}") for c in ("long", "short", "spread", "net")]
    return net.select(*net.columns, *changes, (ratio(F.col("net"), F.col("open_interest")) * 100).alias("net_pct_oi"))
