"""Windows over blocks against the plain windows, in series of all lengths."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.datasets import series as S
from tidemark.operators import blocks as K
from tidemark.operators import trailing as R
from tidemark.settings import Market

SHORT = Market(tiers=(1, 3, 7))


def table(spark, seed=1):
    """Series of 1 to 400 rows, a null key, gaps in order, blanks and ties of values."""
    draw = random.Random(seed)
    out = []
    for key, n in (("a", 400), ("b", 1), ("c", 41), (None, 90), ("d", 40)):
        at = 0
        for _ in range(n):
            at += draw.randrange(1, 4)
            out.append((key, at, None if draw.random() < 0.15 else float(draw.randrange(1, 30))))
    draw.shuffle(out)
    return spark.createDataFrame(out, "k string, t long, v double").repartition(7)


def rows(df):
    def cell(v):
        return round(v, 9) if isinstance(v, float) else [cell(x) for x in v] if isinstance(v, list) else v
    return sorted(([cell(v) for v in r] for r in df.select(sorted(df.columns)).collect()), key=repr)


def same(blocked, plain):
    assert sorted(blocked.columns) == sorted(plain.columns)
    assert rows(blocked) == rows(plain)


@pytest.mark.parametrize("block_rows", [7, 40, 1000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_trailing_windows(spark, block_rows, keys):
    df = table(spark) if keys else table(spark).filter("k = 'a'").drop("k")
    same(R.trailing(df, keys, "t", "v", market=SHORT, block_rows=block_rows), R.trailing(df, keys, "t", "v", market=SHORT))
    same(R.previous_session(df, keys, "t", "v", block_rows=block_rows), R.previous_session(df, keys, "t", "v"))
    same(R.prior_values(df, keys, "t", "v", 5, block_rows=block_rows), R.prior_values(df, keys, "t", "v", 5))


@pytest.mark.parametrize("block_rows", [7, 50])
def test_another_series_before(spark, block_rows):
    current, prior = table(spark, 2).sample(0.4, seed=3), table(spark, 3)
    same(R.trailing_against(current, prior, ["k"], "t", "v", market=SHORT, block_rows=block_rows),
         R.trailing_against(current, prior, ["k"], "t", "v", market=SHORT))
    empty = prior.filter("false")
    same(R.trailing_against(current, empty, ["k"], "t", "v", market=SHORT, block_rows=block_rows),
         R.trailing_against(current, empty, ["k"], "t", "v", market=SHORT))


@pytest.mark.parametrize("block_rows", [1, 13, 1000])
def test_running_totals_and_last_values(spark, block_rows):
    df = table(spark).withColumn("text", F.when(F.col("v") > 20, F.concat(F.lit("x"), F.col("t"))))
    totals = {"s": "v", "n": "t"}
    same(K.running_totals(df, ["k"], "t", totals, block_rows), K.running_totals(df, ["k"], "t", totals))
    lasts = {"before": "v", "word": "text"}
    same(K.last_before(df, ["k"], ["t"], lasts, block_rows), K.last_before(df, ["k"], ["t"], lasts))


@pytest.mark.parametrize("block_rows", [1, 5, 1000])
def test_percent_rank_with_ties_and_blanks(spark, block_rows):
    for keys in (["k"], []):
        df = table(spark)
        same(K.percent_rank(df, keys, "v", "r", block_rows), K.percent_rank(df, keys, "v", "r"))


def test_series_statistics(spark):
    df = table(spark).filter("v IS NOT NULL")
    same(S.extremes(df, "v", ["k"], "t", block_rows=50), S.extremes(df, "v", ["k"], "t"))
    same(S.vol_signals(df, "v", ["k"], "t", year=40, block_rows=61), S.vol_signals(df, "v", ["k"], "t", year=40))
    same(S.moving_average(df, "v", ["k"], "t", block_rows=30), S.moving_average(df, "v", ["k"], "t"))


def test_empty_tables_and_short_blocks(spark):
    none = table(spark).filter("false")
    assert R.trailing(none, ["k"], "t", "v", block_rows=100).count() == 0 and K.percent_rank(none, [], "v", "r", 10).count() == 0
    with pytest.raises(ValueError, match="shorter"):
        R.trailing(none, ["k"], "t", "v", block_rows=59)


def test_one_long_series_in_many_tasks(spark):
    """No window of the plan holds more than a block and its halo, and no exchange has a single partition."""
    n, block = 200_000, 10_000
    df = spark.range(n, numPartitions=16).select(F.col("id").alias("t"), (F.col("id") % 97).cast("double").alias("v"))
    out = K.sliding(df, [], "t", 60, lambda d, by, more: d.select("t", *more, *by), block)
    assert out.groupBy(K.BUCKET).count().agg(F.max("count"), F.count("*")).first() == (block, n // block)
    found = R.trailing(df, [], "t", "v", block_rows=block)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("SinglePartition", plan.split("Window", 1)[1].split("_bucket", 1)[0])
    mean = found.filter("tier = 60 AND n = 60").select(F.avg("avg"), F.count("*")).first()
    assert mean[1] == n - 60 and abs(mean[0] - 48) < 0.01
