"""Landed tapes with an index of polls, so that the polls that count are read without the others.

``land`` stores a tape as Parquet by session, its rows in the order of polls, cut into files of ``rows_per_file`` rows.
Beside it lies an index with the first and last poll of each file. Windows read the last poll at or before each of
their cutoffs; that poll is in a file which begins at or before the cutoff and does not end before the latest of those
begins. ``read_marked`` lists those files only, a handful a session whatever its size, and the window operators give
the same on their rows as on all.

Rows without a poll time are in no window; they are landed and not indexed. Files may overlap in time, as when several
tasks write a session. A session is landed anew as a whole, with its part of the index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parsing import window_cutoff
from tidemark.settings import COTTON, Market, listed
from tidemark.sources import sinks

INDEX = "_polls"  # Spark passes over folders that begin with an underscore
ROWS_PER_FILE = 250_000
_SCHEMA = "file string, first timestamp_ntz, last timestamp_ntz, rows long, session_date date"


def land(tape: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """``sinks.land`` in files of at most ``rows_per_file`` rows, and the index of the sessions it wrote."""
    spark = tape.sparkSession
    sinks.land(tape, path, rows_per_file)
    sessions = [r.session_date for r in tape.select("session_date").distinct().collect()]  # one each
    if not sessions:
        return
    stored = spark.read.parquet(path).select(
        F.col("session_date").cast("date").alias("session_date"), "snap_ts", F.col("_metadata.file_path").alias("file"))
    stored = stored.filter(F.col("session_date").isin(sessions) & F.col("snap_ts").isNotNull())
    index = stored.groupBy("session_date", "file").agg(F.min("snap_ts").alias("first"), F.max("snap_ts").alias("last"), F.count("*").alias("rows"))
    index.select("file", "first", "last", "rows", "session_date").repartition("session_date").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("session_date").parquet(f"{path}/{INDEX}")


def marked_files(spark: SparkSession, path: str, market: Market | Sequence[Market] = COTTON) -> DataFrame:
    """(session_date, file, rows): the files that can hold a poll some window reads."""
    market, day = listed(market)[0], F.col("session_date")
    cutoffs = F.array(window_cutoff(day, market.overnight_end, inclusive=False), window_cutoff(day, market.day_start), window_cutoff(day, market.day_end))
    index = spark.read.schema(_SCHEMA).parquet(f"{path}/{INDEX}")
    begun = index.select("*", F.explode(cutoffs).alias("cutoff")).filter("first <= cutoff")
    latest = begun.groupBy("session_date", "cutoff").agg(F.max("first").alias("latest"))  # a row for each window's end
    return begun.join(latest, ["session_date", "cutoff"]).filter("last >= latest").select("session_date", "file", "rows").distinct()


def read_marked(spark: SparkSession, path: str, market: Market | Sequence[Market] = COTTON) -> DataFrame:
    """The landed rows of the files that windows read; the list of files, a few for each session, passes the driver."""
    files = [r.file for r in marked_files(spark, path, market).collect()]
    schema = "snap_ts timestamp_ntz, contract string, strike double, call_vol double, put_vol double, session_date date"
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*files)
