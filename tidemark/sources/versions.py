"""Tables whose content changes in one step: immutable files, and a manifest per version that names them.

Below a table's folder lie ``_data``, folders of Parquet files that are written once and never changed, and ``_versions``,
one small JSON document per version: which folders hold which part of the table, and how many rows. A reader opens the
latest manifest and reads what it names. A writer first writes its files, then publishes the next manifest under a name that must
not exist yet. So a run that is killed before that leaves the version before readable, and of two writers that
began from the same version one is told to begin again from the other's.

On a local disk the manifest appears under its name by a hard link, elsewhere by a rename that does not overwrite; both
fail if the name is taken. Object stores without such a rename need a table format made for them.

Files of old versions and of runs that were killed stay until ``expire``.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

EMPTY = {"parts": {}}


class Versions:
    """The manifests of one table. A manifest has ``parts``: part name -> {folder, rows}."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._root = self._path(self.path)
        self._fs = self._root.getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _manifest(self, number: int) -> str:
        return f"{self.path}/_versions/{number:012d}.json"

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def load(self, number: int) -> dict:
        stream = self._fs.open(self._path(self._manifest(number)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """Number and manifest of the version that counts; 0 and no parts for a table never written."""
        numbers = self.numbers()
        return (numbers[-1], self.load(numbers[-1])) if numbers else (0, EMPTY)

    def new_folder(self) -> str:
        """A folder for files of a version to come, relative to the table's."""
        return f"_data/{uuid.uuid4().hex}"

    def publish(self, number: int, manifest: dict) -> bool:
        """Make ``manifest`` the version ``number``; False if another writer was first."""
        target = self._manifest(number)
        own = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(own, True)
        stream.write(bytearray(json.dumps({**manifest, "at": time.time()}).encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                local = self._jvm.java.nio.file.Paths
                none = self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)
                self._jvm.java.nio.file.Files.createLink(local.get(self._path(target).toUri().getPath(), none), local.get(own.toUri().getPath(), none))
                return True
            rename = self._jvm.org.apache.hadoop.fs.Options.Rename
            options = self.spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self._conf).rename(own, self._path(target), options)
            return True
        except Py4JJavaError as exc:
            if "FileAlreadyExists" not in exc.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(own, False)

    def read(self, schema, manifest: dict | None = None, parts=None) -> DataFrame:
        """The rows of a version, or of some of its parts; empty where there are none. ``schema`` may be Spark's JSON of one."""
        if isinstance(schema, str) and schema.startswith("{"):
            schema = StructType.fromJson(json.loads(schema))
        listed = (self.latest()[1] if manifest is None else manifest)["parts"]
        folders = [f"{self.path}/{p['folder']}" for name, p in listed.items() if p["rows"] and (parts is None or name in parts)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*sorted(set(folders)))

    def expire(self, keep: int = 10, older_than: float = 24 * 3600) -> int:
        """Remove all but the last ``keep`` versions and files no version kept names; the number of folders removed.

        Folders younger than ``older_than`` seconds may belong to a writer at work and stay.
        """
        numbers = self.numbers()
        used = {p["folder"].split("/")[1] for n in numbers[-keep:] for p in self.load(n)["parts"].values() if p["folder"].startswith("_data/")}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(self._manifest(n)), False)
        removed, data = 0, self._path(f"{self.path}/_data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in used and status.getModificationTime() / 1000 <= time.time() - older_than:
                self._fs.delete(status.getPath(), True)
                removed += 1
        return removed


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The latest version of a table, or the plain Parquet files of a folder that has no versions."""
    versions = Versions(spark, path)
    number, manifest = versions.latest()
    if number:
        return versions.read(schema or manifest["schema"], manifest)
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as exc:
        if schema is None or ("PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc)):
            raise
        return spark.createDataFrame([], schema)
