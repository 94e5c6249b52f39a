"""The market inputs: options tape, boundary sidecar, daily bars, histories.

Layout of the tapes: ``<root>/<YYYY-MM-DD>/<commodity>_options_tape.csv`` and
``<root>/<YYYY-MM-DD>/<commodity>_futures_volume.csv``. The session date is the directory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parsing import clean_code, number_or_null, number_or_zero
from tidemark.settings import BAR_COLUMNS, COTTON, SIDECAR_COLUMNS, Market, listed
from tidemark.sources.delimited import CORRUPT, read_delimited
from tidemark.sources.following import follow_delimited
from tidemark.sources.versions import Versions

_DATE_GLOB = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]"


def session_of_path(path: Column) -> Column:
    """The folder a file lies in, ``<date>`` or ``<name>=<date>``, as a date.

    Plain substrings, as this is evaluated for every row.
    """
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.substring_index(folder, "=", -1).try_cast("date")


def session_files(spark: SparkSession, root: str, name: str, folder: str = _DATE_GLOB) -> DataFrame:
    """Session dates that hold a file of that name, from the listing alone."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/{folder}/{name}")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        raise FileNotFoundError(f"source not found: {root}/*/{name}") from exc
    return files.select(session_of_path(F.col("path")).alias("session_date")) \
        .filter(F.col("session_date").isNotNull()).distinct()


def read_tape(spark: SparkSession, root: str, market: Market | Sequence[Market] = COTTON, session: str = _DATE_GLOB,
              missing: str = "fail", files: str | None = None) -> DataFrame:
    """Options tape of one session or all of them; numbers that do not parse count 0.

    ``files`` replaces the usual folder layout by another pattern below ``root``.
    """
    path = f"{root}/{files or f'{session}/{_file_names(market, "options_tape")}'}"
    return _typed_tape(read_delimited(spark, path, _TAPE_CELLS, missing=missing), market)


def follow_tape(spark: SparkSession, root: str, market: Market | Sequence[Market] = COTTON, session: str = _DATE_GLOB, files: str | None = None) -> DataFrame:
    """The rows of ``read_tape`` as a stream that goes on as the files grow and new ones appear."""
    path = f"{root}/{files or f'{session}/{_file_names(market, "options_tape")}'}"
    return _typed_tape(follow_delimited(spark, path, _TAPE_CELLS), market)


_TAPE_CELLS = ("timestamp", "contract", "strike", "call_vol", "put_vol")


def _file_names(market: Market | Sequence[Market], kind: str) -> str:
    """The file of a market in a session's folder, or a pattern for those of several."""
    names = ",".join(m.prefix.lower() for m in listed(market))
    return f"{names if isinstance(market, Market) else '{' + names + '}'}_{kind}.csv"


def _commodity(market: Market | Sequence[Market]) -> list[Column]:
    """The commodity a file is of, by its name, where a table holds several."""
    name = F.substring_index("file_path", "/", -1)
    return [] if isinstance(market, Market) else [F.upper(F.substring_index(name, "_", 1)).alias("commodity")]


def _typed_tape(raw: DataFrame, market: Market | Sequence[Market]) -> DataFrame:
    return raw.select(
        *_commodity(market), session_of_path(F.col("file_path")).alias("session_date"),
        F.col("timestamp").try_cast("timestamp_ntz").alias("snap_ts"),
        F.col("contract"), number_or_null(F.col("strike")).alias("strike"),
        number_or_zero(F.col("call_vol")).alias("call_vol"),
        number_or_zero(F.col("put_vol")).alias("put_vol"),
        "file_path", "seq", CORRUPT,
    )


def read_sidecar(spark: SparkSession, root: str, market: Market | Sequence[Market] = COTTON, session: str = _DATE_GLOB,
                 missing: str = "empty", files: str | None = None) -> DataFrame:
    """Boundary readings; a file without a required column raises, extra columns are fine."""
    path = f"{root}/{files or f'{session}/{_file_names(market, "futures_volume")}'}"
    raw = read_delimited(spark, path, SIDECAR_COLUMNS, required=SIDECAR_COLUMNS, missing=missing)
    return raw.select(
        session_of_path(F.col("file_path")).alias("session_date"),
        "timestamp", F.upper("commodity").alias("commodity") if not isinstance(market, Market) else F.col("commodity"), "contract", "boundary",
        number_or_null(F.col("volume")).alias("volume"), number_or_null(F.col("oi")).alias("oi"),
        "file_path", "seq", CORRUPT,
    )


def read_bars(spark: SparkSession, path: str, market: Market = COTTON) -> DataFrame:
    """Daily bars from CSV with typed numbers, blank stays null."""
    raw = read_delimited(spark, path, BAR_COLUMNS)
    numbers = [number_or_null(F.col(c)).alias(c) for c in BAR_COLUMNS[3:]]
    return raw.select(F.trim("date").try_cast("date").alias("session_date"),
                      clean_code(F.col("generic")).alias("generic"), "ticker", *numbers, "file_path", "seq")


BARS_SCHEMA = "session_date date, generic string, ticker string, " + ", ".join(f"{c} double" for c in BAR_COLUMNS[3:])


def last_bars(bars: DataFrame) -> DataFrame:
    """All bar columns, blanks included, one row per (date, generic): the last of a file wins."""
    rest = F.struct("ticker", *BAR_COLUMNS[3:])
    return bars.filter(F.col("session_date").isNotNull()).groupBy("session_date", "generic") \
        .agg(F.max_by(rest, F.struct("file_path", "seq")).alias("r")).select("session_date", "generic", "r.*")


def clean_bars(bars: DataFrame, market: Market = COTTON) -> DataFrame:
    """Tracked slots with a volume: blanks are skipped, never zero-filled; last row wins.

    Needs ``seq`` (row order) only where a (date, generic) can repeat; rows of several files are
    ordered by their path first.
    """
    generic = clean_code(F.col("generic"))
    kept = bars.withColumn("generic", generic).filter(
        F.col("generic").isin(*market.slots) & F.col("volume").isNotNull() & F.col("session_date").isNotNull())
    if "seq" not in bars.columns:
        return kept.select("session_date", "generic", "volume")
    order = F.struct("file_path", "seq") if "file_path" in bars.columns else F.col("seq")
    return kept.groupBy("session_date", "generic").agg(F.max_by("volume", order).alias("volume"))


def flatten_history(nested: DataFrame, fields: dict[str, str] | None = None, suffix: str = "") -> DataFrame:
    """(security, fieldData array) to long daily bars; absent fields stay null.

    ``fields`` maps the bar columns to the source's field names (the same names by default);
    ``suffix`` is what the source appends to a generic.
    """
    fields = {c: (fields or {}).get(c, c) for c in BAR_COLUMNS[3:]}
    rows = nested.select("security", F.explode("fieldData").alias("r"))
    given = set(rows.schema["r"].dataType.fieldNames())
    values = [(F.col(f"r.{src}").try_cast("double") if src in given else F.lit(None).cast("double")).alias(name)
              for name, src in fields.items()]
    return rows.select(
        F.col("r.date").try_cast("date").alias("session_date"),
        F.trim(F.replace("security", F.lit(suffix), F.lit("")) if suffix else F.col("security")).alias("generic"),
        F.col("security").alias("ticker"), *values,
    ).filter(F.col("session_date").isNotNull())


def read_history(spark: SparkSession, path: str, schema: str, commodity: str | None = None) -> DataFrame:
    """A permanent history table; empty when it was never written. Case-insensitive filter."""
    versions = Versions(spark, path)
    number, manifest = versions.latest()
    if number:
        df = versions.read(manifest.get("schema", schema), manifest)
    else:
        try:
            df = spark.read.parquet(path)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
            df = spark.createDataFrame([], schema)
    return df if commodity is None else df.filter(F.upper("commodity") == commodity.upper())


def prior_series(history: DataFrame, column: str, commodity: str) -> DataFrame:
    """(date, value) of one history column, text or numeric, blanks dropped."""
    return history.filter(F.upper("commodity") == commodity.upper()).select(
        F.col("date").cast("date").alias("session_date"),
        number_or_null(F.col(column)).alias("value")).filter(F.col("value").isNotNull())


