"""Helpers the operators share: shared scratch space, settled tables, unused column names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _own_root()
    return root.rstrip("/")


@cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-llm-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_SCOPES: list[list[str]] = [[]]


@contextmanager
def scope(spark: SparkSession):
    """Tables ``written`` inside are removed at the end, those of other results are left; scopes nest."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


class Scratch:
    """Tables of one computation, by name, removed as soon as it has read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = shared_path(self.spark, name)
        return _stored(df, self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names or [*self.paths]:
            remove(self.spark, self.paths.pop(name))


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder until Spark drops them."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder.

    Unlike a checkpoint it is compressed and has exact sizes, so joins choose by them.
    """
    path = shared_path(df.sparkSession, name)
    _SCOPES[-1].append(path)
    return _stored(df, path)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not have, whatever its extra columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(text: Column, pattern: str) -> Column:
    """How many times a pattern without the letter x outside its matches occurs.

    Every match becomes one x. The pattern must match every x of the text, so that those left
    are the matches; this allocates one string instead of one for each match.
    """
    marked = F.regexp_replace(text, pattern, "x")
    return (F.length(marked) - F.length(F.replace(marked, F.lit("x"), F.lit("")))).cast("long")


@cache
def _package() -> str:
    """A zip of this package in the driver's own temporary folder; Spark hands it to the executors."""
    root = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for file in sorted((root / "tidemark").rglob("*.py")):
            z.write(file, file.relative_to(root))
    return str(out)


def parts(batches, rows: int = 512):
    """Arrow batches cut small, as their texts become Python objects: a worker holds few at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        pa.default_memory_pool().release_unused()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, once per application; call before using a Python function."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        spark.sparkContext.addPyFile(_package())
        _SHIPPED.add(application)
