"""A place for tables that must outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


_SCOPES: list[list[str]] = [[]]


@contextmanager
def scope(spark: SparkSession):
    """Folders given inside are removed at the end, those of other results are left; scopes nest."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _SCOPES.pop():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without that setting and gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_folder()
    _SCOPES[-1].append(f"{root.rstrip('/')}/{uuid.uuid4().hex}")
    return _SCOPES[-1][-1]


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut lineage with a written table: survives lost executors and has exact statistics."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
