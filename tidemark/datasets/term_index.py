"""An inverted index over texts: which documents hold a word, without reading the texts.

A posting list is cut into blocks of ``SPAN`` document numbers; a row has a word, a block and the places in the block
as offsets from its begin, so no row grows with the corpus, however common the word. Rows lie in folders by a hash of
the word (``BUCKETS``), sorted by word and block, beside a table of the words' document counts. A search reads the folders of
its words only, takes the lists by rising count and intersects them block by block; what is left is looked up in the
documents and held against the texts once more, so repeated or odd ids cannot give a wrong row.

Words are those of ``documents.search``. Defined cases: a null text has no words; ids that are no whole numbers are
numbered by their hash; null ids are one number; a term without a word finds all documents of the dates, as there; a
word that is nowhere finds none; an empty table gives an empty index.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.datasets.documents import search
from tidemark.datasets.slices import where

BUCKETS = 64
SPAN = 1 << 16
_SEPARATORS = r"[^\p{L}\p{N}]+"


def _number(df: DataFrame, key: str) -> Column:
    """A whole number for an id; different ids may share one."""
    kind = df.schema[key].dataType
    number = F.col(key).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(key)
    return F.coalesce(number, F.lit(-1).cast("long"))


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def build(documents: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``documents`` below ``path``: ``postings`` and ``words``."""
    word = F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SEPARATORS)))
    rows = documents.select(_number(documents, key).alias("number"), word.alias("word")).filter("word <> ''")
    block = F.shiftright("number", SPAN.bit_length() - 1)
    offset = F.col("number").bitwiseAND(F.lit(SPAN - 1)).cast("int")
    lists = rows.select("word", block.alias("block"), offset.alias("offset")) \
        .groupBy("word", "block").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))
    lists.withColumn("bucket", _bucket(F.col("word"), buckets)).repartitionByRange("bucket", "word", "block") \
        .sortWithinPartitions("bucket", "word", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = documents.sparkSession.read.schema("word string, block long, offsets array<int>, bucket int").parquet(f"{path}/postings")
    counts = stored.groupBy("bucket", "word").agg(F.sum(F.size("offsets")).alias("documents"))
    counts.repartitionByRange("bucket", "word").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{path}/words")


def _words(term: str | None) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", (term or "").lower())))


def _read(spark: SparkSession, path: str, table: str, schema: str, words: list[str], buckets: int) -> DataFrame:
    rows = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{table}")
    wanted = spark.range(1).select(*[_bucket(F.lit(w), buckets) for w in words]).first()
    return rows.filter(F.col("bucket").isin(sorted(set(wanted))) & F.col("word").isin(words))


def counts(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> dict[str, int]:
    """In how many documents each of a few words stands."""
    return {r.word: r.documents for r in _read(spark, path, "words", "word string, documents long", words, buckets).collect()}


def numbers(spark: SparkSession, path: str, term: str, buckets: int = BUCKETS) -> DataFrame:
    """The numbers of the documents that hold every word of ``term``."""
    words = _words(term)
    known = counts(spark, path, words, buckets)
    if len(known) < len(words):
        return spark.createDataFrame([], "number long")
    found = None
    for word in sorted(words, key=lambda w: (known[w], w)):
        lists = _read(spark, path, "postings", "word string, block long, offsets array<int>", [word], buckets).select("block", "offsets")
        if found is None:
            found = lists
        else:
            found = found.join(lists.withColumnRenamed("offsets", "more"), "block") \
                .select("block", F.array_intersect("offsets", "more").alias("offsets")).filter(F.size("offsets") > 0)
    return found.select(F.explode("offsets").alias("offset"), "block").select((F.col("block") * SPAN + F.col("offset")).alias("number"))


def indexed_search(documents: DataFrame, path: str, key: str, text: str, date: str, term: str | None = None, start: str | None = None,
                   end: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``documents.search``, found through the index at ``path``."""
    if not _words(term):
        return search(documents, text, date, term, start, end)
    hits = numbers(documents.sparkSession, path, term, buckets)
    picked = where(documents, date, start, end).withColumn("_number", _number(documents, key)) \
        .join(hits, F.col("_number") == F.col("number"), "left_semi").drop("_number")
    return search(picked, text, date, term)
