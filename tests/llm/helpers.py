"""Small tables with the odd rows every operator must take: nulls, empties, repeats, long texts."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """From (doc_id, text) or (doc_id, text, source) rows."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def crowded(df):
    """With extra columns named like helpers and results of the operators."""
    extra = ("size", "source_size", "target", "copies", "copy", "bits", "h", "key", "score", "text_", "words", "found", "start",
             "kept_id", "kept_h", "kept_times", "root", "node", "count", "gate", "host", "tree", "level", "call_id", "source_key")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra) if c not in df.columns])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
