"""The index finds what a scan of the texts finds, and reads the folders of its words only."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.datasets import term_index as X
from tidemark.datasets.documents import search

SCHEMA = "id long, text string, day date"


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, day string").withColumn("day", F.col("day").cast("date"))


def same(spark, df, path, key="id", **how):
    found = X.indexed_search(df, path, key, "text", "day", **how)
    want = search(df, "text", "day", how.get("term"), how.get("start"), how.get("end"))
    assert found.columns == df.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    return found


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    draw = random.Random(3)
    words = ["the", "of", "Cotton", "café", "x1", "rare", "don't", "ÉTÉ", "2024"]
    rows = [(draw.choice([k, k, k * 70_001, -k]), " ".join(draw.choice(words[:draw.randrange(1, 9) + 1]) for _ in range(draw.randrange(0, 12))) + draw.choice(["", ".", "_z"]),
             f"2024-01-{draw.randrange(1, 29):02d}") for k in range(400)]
    rows += [(None, "null id the", "2024-01-01"), (7, None, "2024-01-01"), (8, "", None), (9, "the", None), (5, "the of", "2024-01-02"), (5, "of", "2024-01-02")]
    df, path = table(spark, rows), str(tmp_path_factory.mktemp("index"))
    X.build(df.repartition(6), "id", "text", path)
    return df, path


@pytest.mark.parametrize("term", ["the", "THE of", "cotton café", "été 2024", "don't", "rare x1 the of", "nowhere", "the nowhere", "", None, "!?", "th", "z", "null"])
def test_same_rows_as_a_scan(spark, indexed, term):
    same(spark, *indexed, term=term)
    same(spark, *indexed, term=term, start="2024-01-05", end="2024-01-20")


def test_only_the_folders_of_the_words_are_read(spark, indexed):
    df, path = indexed
    found = X.numbers(spark, path, "cotton the")
    buckets = {f"bucket={b}" for b in spark.range(1).select(*[X._bucket(F.lit(w), X.BUCKETS) for w in ("cotton", "the")]).first()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    found.collect()
    read = {f.split("/")[-2] for f in found.inputFiles()}
    assert buckets <= read and len(list((Path(path) / "postings").glob("bucket=*"))) > len(buckets)
    assert X.counts(spark, path, ["cotton"])["cotton"] == search(df.filter("id is not null"), "text", "day", "cotton").select("id").distinct().count()


def test_lists_are_sorted_blocks(spark, indexed):
    rows = spark.read.parquet(f"{indexed[1]}/postings").collect()
    assert all(list(r.offsets) == sorted(set(r.offsets)) and 0 <= r.offsets[0] and r.offsets[-1] < X.SPAN for r in rows)
    assert len({(r.word, r.block) for r in rows}) == len(rows) and len({r.block for r in rows}) > 100


def test_ids_that_are_texts_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "the one", None), ("b", "two", None), (None, "the", None)], "id string, text string, day date")
    X.build(df, "id", "text", f"{tmp_path}/a")
    assert same(spark, df, f"{tmp_path}/a", term="the").count() == 2
    none = df.filter("false")
    X.build(none, "id", "text", f"{tmp_path}/b")
    assert X.indexed_search(none, f"{tmp_path}/b", "id", "text", "day", term="the").count() == 0
