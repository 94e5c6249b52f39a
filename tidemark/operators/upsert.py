"""Keyed, idempotent upserts of permanent histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], merge: str = "replace") -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; all other rows are kept.

    ``replace`` swaps the whole row, ``coalesce`` keeps old values where the new ones are
    null. Columns the old table does not have are ignored.
    """
    columns = old.columns
    known = [c for c in columns if c in new.columns]
    incoming = new.select(*known)
    if merge == "coalesce":
        rest = [c for c in columns if c not in keys]
        pick = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in known
                else F.col(f"o.{c}").alias(c) for c in rest]
        joined = old.alias("o").join(incoming.alias("n"), list(keys), "full_outer")
        return joined.select(*keys, *pick).select(*columns)
    kept = old.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True).select(*columns)


def merge_counts(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New, kept and total row counts of a replace merge, in one pass over both sides."""
    sides = old.select(*keys, F.lit(0).alias("fresh")).unionByName(new.select(*keys, F.lit(1).alias("fresh")))
    per_key = sides.groupBy(*keys).agg(
        F.sum("fresh").alias("n_new"), F.sum(1 - F.col("fresh")).alias("n_old"))
    return per_key.agg(
        F.coalesce(F.sum("n_new"), F.lit(0)).alias("n_new"),
        F.coalesce(F.sum(F.when(F.col("n_new") == 0, F.col("n_old"))), F.lit(0)).alias("n_kept"),
    ).withColumn("n_total", F.col("n_new") + F.col("n_kept"))
