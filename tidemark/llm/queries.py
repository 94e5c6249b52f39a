"""Registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import chats, credentials, decontaminate, host_rules, licenses, mixing, mtree, simhash, site_tree, token_files, toxicity, turn_repair, whitening
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_inner_product_search": lambda spark, sf: mtree.top_k(table(spark, sf, "embeddings")),
    "op2_source_mix": lambda spark, sf: mixing.taken(table(spark, sf, "documents")),
    "op3_license_scan": lambda spark, sf: licenses.digest(table(spark, sf, "documents")),
    "op4_secret_scan": lambda spark, sf: credentials.digest(table(spark, sf, "documents")),
    "op5_simhash_groups": lambda spark, sf: simhash.linked(table(spark, sf, "documents")),
    "op6_token_files": lambda spark, sf: token_files.tokenized(table(spark, sf, "documents")),
    "op7_toxicity": lambda spark, sf: toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op8_main_text": lambda spark, sf: site_tree.extracted(table(spark, sf, "pages")),
    "op9_chat_lines": lambda spark, sf: chats.formatted(table(spark, sf, "conversations")),
    "op10_benchmark_matches": lambda spark, sf: decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op11_host_rules": lambda spark, sf: host_rules.digest(table(spark, sf, "documents")),
    "op12_whitened_components": lambda spark, sf: whitening.whitened(table(spark, sf, "embeddings")),
    "op13_turn_repair": lambda spark, sf: turn_repair.repaired(table(spark, sf, "conversations")),
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op1_inner_product_search": mtree.TOP_K_SQL, "op2_source_mix": mixing.TAKEN_SQL, "op9_chat_lines": chats.FORMATTED_SQL,
                       "op11_host_rules": host_rules.DIGEST_SQL}
