"""Windows over series that are too long for one task.

A plain window holds a whole series in one task. Here the rows of all series are sorted over all tasks, numbered by block
counts, and cut into buckets of ``block_rows`` consecutive rows. A sliding frame of at most ``reach`` rows needs the
bucket and the last ``reach`` rows before it, its halo, which are copied into it; running totals and last values need
one number from each bucket before. So a partition has at most ``block_rows + reach`` rows, whatever the series.

The results are those of the plain windows. It takes three exchanges of the rows instead of one, so it pays for series of
millions of rows, not for decades of sessions: callers choose by ``block_rows``, None being the plain window.

Keys may be null (a series of its own) and may be none (one series). Rows must differ in their order within a series, as
for any frame of rows. The sorted rows are written to the shared folder, since block numbers must not change.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sizing import written

BLOCK_ROWS = 100_000
BUCKET, POSITION, OWN = "_bucket", "_position", "_own"
_BLOCK = "_block"


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null; those of ``right`` are dropped. Without columns ``right`` is one row."""
    if not on:
        only = right.first()
        return left.withColumns({c: F.lit(only[c] if only else None).cast(right.schema[c].dataType) for c in right.columns})
    other = right.withColumnsRenamed({c: f"_r{c}" for c in on})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in on])
    return left.join(other, same, how).drop(*[f"_r{c}" for c in on])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int) -> DataFrame:
    """``df`` with the position of each row in its series, from 0, and its bucket."""
    series = [*keys, *order]
    blocks = written(df.repartitionByRange(*series).sortWithinPartitions(*series).withColumn(_BLOCK, F.spark_partition_id()))
    within = [*keys, _BLOCK]
    counts = blocks.groupBy(*within).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK)  # one row for each block of a series
    offsets = counts.withColumn("_before", F.sum("_n").over(earlier) - F.col("_n")).drop("_n")
    at = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1
    placed = joined(blocks.withColumn("_at", at), offsets, within)
    return placed.withColumn(POSITION, F.col("_before") + F.col("_at")).drop(_BLOCK, "_at", "_before") \
        .withColumn(BUCKET, F.floor(F.col(POSITION) / block_rows))


def sliding(df: DataFrame, keys: Sequence[str], order: str, reach: int, make: Callable[[DataFrame, list[str], list[str]], DataFrame],
            block_rows: int | None = None) -> DataFrame:
    """``make(rows, by, more)`` with its windows partitioned ``by`` these columns, each of at most ``reach`` rows back.

    ``make`` keeps the columns ``more`` beside its own.
    """
    if block_rows is None:
        return make(df, list(keys), [])
    if reach > block_rows:
        raise ValueError(f"a block of {block_rows} rows is shorter than the frame of {reach}")
    rows = numbered(df, keys, [order], block_rows)
    last = F.col(POSITION) % block_rows >= block_rows - reach
    places = F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copied = rows.withColumn("_ahead", F.explode(places)).withColumn(BUCKET, F.col(BUCKET) + F.col("_ahead")) \
        .withColumn(OWN, F.col("_ahead") == 0).drop("_ahead", POSITION)
    return make(copied, [*keys, BUCKET], [OWN]).filter(OWN).drop(OWN)


def running_totals(df: DataFrame, keys: Sequence[str], order: str, totals: dict[str, str], block_rows: int | None = None) -> DataFrame:
    """``df`` with running sums, this row included: name of the sum -> column."""
    def sums(by: Sequence[str]) -> dict[str, Column]:
        frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return {name: F.sum(c).over(frame) for name, c in totals.items()}

    if block_rows is None:
        return df.withColumns(sums(keys))
    rows = numbered(df, keys, [order], block_rows).drop(POSITION)
    within = [*keys, BUCKET]
    per = rows.groupBy(*within).agg(*[F.sum(c).alias(f"_s{name}") for name, c in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*within, *[F.sum(f"_s{name}").over(earlier).alias(f"_b{name}") for name in totals])
    out = joined(rows.withColumns(sums(within)), before, within)
    # a sum without any value so far is null, as in the plain window
    return out.withColumns({name: F.coalesce(F.col(name) + F.col(f"_b{name}"), name, f"_b{name}") for name in totals}) \
        .drop(BUCKET, *[f"_b{name}" for name in totals])


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], block_rows: int | None = None) -> DataFrame:
    """``df`` with the last value that is not null of strictly earlier rows: name -> column."""
    def lasts(by: Sequence[str]) -> dict[str, Column]:
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return {name: F.last(c, ignorenulls=True).over(frame) for name, c in values.items()}

    if block_rows is None:
        return df.withColumns(lasts(keys))
    rows = numbered(df, keys, order, block_rows)
    within = [*keys, BUCKET]
    # the value is wrapped, so that max_by takes any type and skips rows without one
    per = rows.groupBy(*within).agg(*[F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.col(POSITION))).alias(f"_s{name}")
                                      for name, c in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*within, *[F.last(f"_s{name}", ignorenulls=True).over(earlier).alias(f"_b{name}") for name in values])
    out = joined(rows.withColumns(lasts(within)), before, within)
    return out.withColumns({name: F.coalesce(F.col(name), F.col(f"_b{name}")["v"]) for name in values}) \
        .drop(BUCKET, POSITION, *[f"_b{name}" for name in values])


def percent_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, block_rows: int | None = None) -> DataFrame:
    """``df`` with ``percent_rank`` of ``value`` in its series (0 to 1; equal values share the lowest; nulls come first).

    Equal values are one row with a count before anything is sorted, and the rank of a value is the running total of
    the counts before it; so neither a long series nor a common value is in one task.
    """
    if block_rows is None:
        return df.withColumn(name, F.percent_rank().over(Window.partitionBy(*keys).orderBy(value)))
    columns = [*keys, value]
    kinds = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    ranked = running_totals(kinds, keys, value, {"_upto": "_n"}, block_rows)
    sizes = kinds.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = joined(ranked, sizes, keys)
    share = F.when(F.col("_all") > 1, (F.col("_upto") - F.col("_n")) / (F.col("_all") - 1)).otherwise(0.0)
    return joined(df, ranked.select(*columns, share.alias(name)), columns)
