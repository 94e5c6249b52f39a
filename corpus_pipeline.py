"""From raw documents to token files: five stages, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays (texts whose five-word shingles have a similarity of
0.8 or more, found by their fingerprints and by minima of their shingles, compared exactly), documents that hold test
items go, sources are mixed to their targets (so a document may come more than once), and the rest is written as files
of token ids. A stage sees all rows its predecessor kept. Tables of ``sf_dir`` other than the documents (labels,
benchmark) are read where a stage needs them.

Defined cases, for every stage: a null or empty text is no toxic one, is a copy of every other such text, holds no test
item, is repeated at its source's rate like any other and has one token, the end; rows with the same id are rows of their own; an empty table goes through as an empty table; extra
columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, near_copies, token_files, toxicity
from tidemark.llm.common import remove, scope, shared_path, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicated(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", without_test_items),
    ("source_mix", source_mix),
    ("token_ids", write_token_files),
]

ORACLE_SQL = None  # the network, the fingerprints and the tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; doc_id, start, n_tokens, ids_crc32 of what was written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scope(spark):  # what a stage settles on its way is not needed any more
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
