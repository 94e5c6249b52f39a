"""Delimited files whose headers may differ from file to file.

Spark's CSV reader maps a user schema by position and takes the header of one file for all,
so a reordered file would be read wrongly without an error. Here the header of every file is
read first (its first line only, on executors) and cells are picked by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sizing import shared_folder

CORRUPT = "_corrupt_record"


def _openable(path: str) -> bool:
    """Can tasks open files of this scheme themselves? Other stores are read by Spark only."""
    scheme = path.partition(":")[0] if ":" in path.split("/")[0] else ""
    return scheme in ("", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def line_reader():
    """Functions for tasks, made here so that they travel by value to workers without this package."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    def first_line(file, block: int = 1 << 13) -> bytes:
        """The bytes of an open file up to its first line break; no more is read than one block too many."""
        parts = []
        while True:
            part = file.read(block)
            at = part.find(b"\n")
            parts.append(part if at < 0 else part[:at])
            if at >= 0 or not part:
                return b"".join(parts).removesuffix(b"\r")

    def lines(batches):
        for batch in batches:
            paths, found = batch.column("file_path").to_pylist(), []
            for uri in paths:
                fs, name = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
                with fs.open_input_file(name) as file:
                    found.append(first_line(file).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], ["file_path", "value"])

    return first_line, lines


def _listed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, value): the first line of each file. Files are listed by Spark and opened in tasks, a few kilobytes each."""
    listing = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file_path"), "length")
    return listing.filter("length > 0").select("file_path").mapInArrow(line_reader()[1], "file_path string, value string")


def _scanned_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from a scan of all lines, for stores that only Spark can open: the first row of a file's first split is kept."""
    probe = spark.newSession()
    probe.conf.set("spark.sql.files.openCostInBytes", str(1 << 50))  # no two splits in a partition
    lines = probe.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"),
                                         F.col("_metadata.file_block_start").alias("block"))
    # the lower 33 bits of the id number the rows of a partition
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.withColumn("row", row).filter("row = 0 AND block = 0").select("file_path", "value")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, header) per file, written once for the checks that follow.

    The bytes read do not grow with the size of the files, where tasks can open them.
    """
    first = _listed_lines(spark, path) if _openable(path) else _scanned_lines(spark, path)
    names = F.split(F.regexp_replace("value", r"^\uFEFF", ""), ",", -1)
    plain = F.transform(names, lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    target = shared_folder(spark)
    first.select("file_path", plain.alias("header")).repartition("file_path").write.parquet(target)
    return spark.read.parquet(target)


def _soft(action, path: str, missing: str):
    """Apply the missing-source policy: 'fail' names the path, 'empty' returns None."""
    try:
        return action()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        if missing == "empty":
            return None
        raise FileNotFoundError(f"source not found: {path}") from exc


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], *,
                   required: Sequence[str] = (), missing: str = "fail") -> DataFrame:
    """All files below ``path`` as text columns picked by name, with scan metadata.

    Adds ``file_path``, ``seq`` (order of rows within a file, also across splits) and
    ``_corrupt_record`` (the raw line where it did not fit its header, else null). A column a
    file does not have is null. A file that lacks a ``required`` column raises ValueError.
    """
    empty_schema = ", ".join(f"`{c}` string" for c in columns) + \
        f", file_path string, seq struct<block: bigint, row: bigint>, `{CORRUPT}` string"
    found = _soft(lambda: headers(spark, path), path, missing)
    if found is None:
        return spark.createDataFrame([], empty_schema)
    if required:
        need = F.array(*[F.lit(c) for c in required])
        bad = found.select("file_path", F.array_except(need, "header").alias("missing")) \
            .filter(F.size("missing") > 0).limit(1).collect()
        if bad:
            raise ValueError(f"schema drift in {bad[0].file_path}: missing column(s) {list(bad[0].missing)}, "
                             f"expected {list(required)}")
    signatures = found.select("header").distinct().limit(2).collect()
    if not signatures:
        return spark.createDataFrame([], empty_schema)
    if len(signatures) == 1:
        return _same_header(spark, path, list(signatures[0].header), columns)
    width = found.agg(F.max(F.size("header")).alias("w")).collect()[0].w
    return _mixed_headers(spark, path, found, width, columns)


def _seq():
    return F.struct(F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row")).alias("seq")


def _scan(spark: SparkSession, path: str, names: Sequence[str], header: bool) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in names) + f", `{CORRUPT}` string"
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).csv(path)


def _same_header(spark, path, header, columns) -> DataFrame:
    raw = _scan(spark, path, header, header=True)
    picked = [F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in columns]
    return raw.select(*picked, F.col("_metadata.file_path").alias("file_path"), _seq(), CORRUPT)


def _mixed_headers(spark, path, found, width, columns) -> DataFrame:
    """Files with different headers: join each row to its file's header, pick by position."""
    cells = [f"_c{i}" for i in range(width)]
    raw = _scan(spark, path, cells, header=False).select(
        F.array(*cells).alias("cells"), F.col("_metadata.file_path").alias("file_path"), _seq(), CORRUPT)
    rows = raw.join(found, "file_path").filter(
        F.slice("cells", 1, F.size("header")) != F.col("header"))

    def pick(c: str):
        at = F.array_position("header", c)
        return F.when(at > 0, F.try_element_at("cells", at.cast("int"))).alias(c)

    # a narrower file is short against the common width, which is not a defect of the row
    short = F.size(F.split(CORRUPT, ",", -1)) == F.size("header")
    return rows.select(*[pick(c) for c in columns], "file_path", "seq",
                       F.when(~short, F.col(CORRUPT)).alias(CORRUPT))


def quarantine(df: DataFrame) -> DataFrame:
    """Rows that did not fit their header, with the file they came from and what was read of them.

    Spark refuses a scan of nothing but the rejected lines, so use something of ``parsed`` too.
    """
    parsed = F.struct(*[c for c in df.columns if c not in ("file_path", "seq", CORRUPT)])
    return df.filter(F.col(CORRUPT).isNotNull()).select("file_path", "seq", CORRUPT, parsed.alias("parsed"))
