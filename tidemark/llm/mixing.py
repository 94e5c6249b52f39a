"""Mix sources to target weights (operator 2). DataFrame functions only.

Words are summed per source; sources share a budget by weight, no source above a multiple of its
own size; a source's repetition rate is its target over its size. A document is emitted floor(rate)
times, and once more when its hash-seeded number falls below the fraction of the rate.

Defined cases: a null or empty text has size 0; null is a source of its own, the last; rows with
the same id share one draw (a null id draws as the text ``null``); a source without words has target
0 and rate 0; an empty table gives an empty result; columns beyond those read are kept by ``mix``
and never clash with helpers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import matches, unused, written

WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]++"  # single signs are looked up in a table, ranges tested in turn
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"


def word_count(text: Column) -> Column:
    return matches(F.coalesce(text, F.lit("")), WORD)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row per source of ``sizes`` (source, size).

    Sharing by weight and resharing what exceeds a source's ceiling ends where every source has
    min(ceiling, level * weight). With sources in the order of ceiling / weight, the level is what is
    left for the first source it does not lift above its ceiling. The windows run over one row per
    source, after the sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("ratio", "place")
    everything = Window.partitionBy()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("place", F.row_number().over(order)) \
        .withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)) \
        .withColumn("ceiling", F.col("source_size") * most) \
        .withColumn("ratio", F.col("ceiling").cast("double") / F.col("weight"))
    left = ranked.withColumn("budget", F.sum("source_size").over(everything).cast("double") * share) \
        .withColumn("full", F.sum("ceiling").over(filling) - F.col("ceiling")) \
        .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(filling) + F.col("weight")) \
        .withColumn("at", F.row_number().over(filling)) \
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    first = left.withColumn("stop", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("at"))).over(everything)) \
        .withColumn("level", F.max(F.when(F.col("at") == F.col("stop"), F.col("level"))).over(everything))
    target = F.when(F.col("at") < F.col("stop"), F.col("ceiling").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return first.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the hash of seed and key: the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def planned(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED,
            names=("size", "source_size", "target", "copies")) -> DataFrame:
    """``docs`` with the size, its source's size and target, and how often the mix emits it.

    The table of targets is written, so that Spark broadcasts it by its real size or, beyond its
    threshold, shuffles both sides and splits hot sources.
    """
    size, source_size, target, copies = names
    targets = written(source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, most), "targets")
    key, = unused(docs.select(*docs.columns, *[F.lit(0).alias(n) for n in names]), "source_key")
    side = targets.select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target))
    sized = docs.withColumn(size, word_count(F.col("text")))
    joined = sized.join(side, sized["source"].eqNullSafe(side[key]), "left").drop(key)
    rate = F.when(F.col(source_size) > 0, F.least(F.col(target) / F.col(source_size), F.lit(float(most)))).otherwise(0.0)
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(copies, F.floor(rate) + extra)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: every emitted copy is a row with the columns of ``docs``."""
    names = unused(docs, "size", "source_size", "target", "copies", "copy")
    plan = planned(docs, names=tuple(names[:4]), **how)
    copies, copy = F.col(names[3]), names[4]
    return plan.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and the number of copies, one row per document."""
    plan = planned(docs.select("doc_id", "text", "source"), **how)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


TAKEN_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM per),
weighed AS (
  SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::BIGINT]::BIGINT AS weight, source_size * 2 AS ceiling FROM ranked),
rated AS (SELECT *, ceiling::DOUBLE / weight AS ratio FROM weighed),
filled AS (
  SELECT *, (SELECT sum(source_size) FROM per)::DOUBLE * 1.5::DOUBLE AS budget,
    sum(ceiling) OVER (ORDER BY ratio, place) - ceiling AS full_before,
    (SELECT sum(weight) FROM weighed) - sum(weight) OVER (ORDER BY ratio, place) + weight AS open_weight,
    row_number() OVER (ORDER BY ratio, place) AS nth FROM rated),
levels AS (SELECT *, (budget - full_before::DOUBLE) / open_weight::DOUBLE AS lvl FROM filled),
stop AS (SELECT min(nth) AS stop FROM levels WHERE lvl <= ratio),
lift AS (SELECT stop, lvl FROM levels, stop WHERE nth = stop),
targets AS (
  SELECT source, source_size, CASE WHEN nth < lift.stop THEN ceiling::DOUBLE ELSE lift.lvl * weight END AS target
  FROM levels, lift),
rates AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(target / source_size::DOUBLE, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken,
  (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM rates
"""
