"""Sinks: permanent history tables, nested JSON payloads, report text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.formats import fixed
from tidemark.operators.sizing import written
from tidemark.operators.upsert import upsert
from tidemark.sources.versions import Versions


_NO_YEAR = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder for rows without a date


class ConflictError(RuntimeError):
    """Other writers were first each time a commit was tried."""


class HistoryTable:
    """A table with a part for each year that is only ever changed by keyed upserts, each a version of its own.

    An upsert reads the years it touches, writes them anew as files of their own, and then names them in the next
    version (``versions``). Readers see the version before until then, also if the run is killed. If another
    writer was first, years it did not touch are taken into the next version as they are; otherwise the merge is
    done again on its rows. What was written is counted while it is written.

    A folder of the former layout (``year=...`` folders without versions) is taken as the first version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], date: str = "date"):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.date = list(keys), date
        self.versions = Versions(spark, path)

    def _latest(self) -> tuple[int, dict]:
        number, manifest = self.versions.latest()
        return (number, manifest) if number else (0, {"parts": self._plain_years()})

    def _plain_years(self) -> dict:
        try:
            files = self.spark.read.schema(f"{self.schema}, year int").parquet(self.path)
            return {str(r.year): {"folder": f"year={_NO_YEAR if r.year is None else r.year}", "rows": r["count"]}
                    for r in files.groupBy("year").count().collect()}
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return {}

    def rows(self) -> DataFrame:
        return self.versions.read(self.schema, self._latest()[1])

    def read(self) -> DataFrame:
        return self.rows().withColumn("year", F.year(F.col(self.date).cast("date")))

    def upsert(self, new: DataFrame, merge: str = "replace", attempts: int = 10) -> dict[str, int]:
        """Merge ``new`` into the table; how many rows are new (or changed), kept, and there in all."""
        year = F.year(F.col(self.date).cast("date"))
        incoming = written(new)
        years = sorted(str(r.y) for r in incoming.select(year.alias("y")).distinct().collect())
        base, made = None, None
        for _ in range(attempts):
            number, manifest = self._latest()
            parts = manifest["parts"]
            seen = {y: parts.get(y) for y in years}
            if made is None or seen != base:
                base, made = seen, self._written(manifest, incoming, years, merge)
            folder, new_rows, counts = made
            after = {**parts, **{y: {"folder": f"{folder}/year={_NO_YEAR if y == 'None' else y}", "rows": counts[y]} for y in years}}
            total = sum(p["rows"] for p in after.values())
            if not years or self.versions.publish(number + 1, {"parts": after, "schema": self.schema}):
                return {"n_new": new_rows, "n_kept": total - new_rows, "n_total": total}
        raise ConflictError(f"{self.path}: {attempts} commits were overtaken")

    def _written(self, manifest: dict, incoming: DataFrame, years: list[str], merge: str) -> tuple[str, int, dict[str, int]]:
        """Write the merged years; their folder, the rows of ``incoming`` among them and the rows of each year."""
        folder = self.versions.new_folder()
        if not years:
            return folder, 0, {}
        touched = self.versions.read(self.schema, manifest, years)
        fresh = incoming.select(*self.keys).distinct().withColumn("_fresh", F.lit(1))
        if merge == "replace":
            kept = touched.join(fresh.drop("_fresh"), self.keys, "left_anti").withColumn("_fresh", F.lit(0))
            known = [c for c in touched.columns if c in incoming.columns]
            merged = kept.unionByName(incoming.select(*known).withColumn("_fresh", F.lit(1)), allowMissingColumns=True)
        else:
            merged = upsert(touched, incoming, self.keys, merge).join(fresh, self.keys, "left")
        merged = merged.withColumn("year", F.year(F.col(self.date).cast("date")))
        seen = Observation()
        counted = merged.observe(seen, F.count_if(F.col("_fresh") == 1).alias("new"),
                                 *[F.count_if(F.col("year").eqNullSafe(F.lit(None if y == "None" else int(y)))).alias(f"y{y}") for y in years])
        counted.drop("_fresh").write.partitionBy("year").parquet(f"{self.path}/{folder}")
        found = seen.get
        return folder, found["new"], {y: found[f"y{y}"] for y in years}

    def export_csv(self, path: str, money: dict[str, int]) -> None:
        """Text copy with fixed decimals, sorted by key. ``money``: column -> decimals."""
        cols = [fixed(F.col(c), money[c]).alias(c) if c in money
                else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in self.rows().columns]
        self.rows().orderBy(*self.keys).select(*cols).write.mode("overwrite").option("header", True).csv(path)


def land(tape: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Tape as Parquet, one folder per session, polls in order.

    No shuffle: a tape file is read by one task and written by it. The order makes the poll
    column compress to almost nothing, and later scans read only the columns they use. ``rows_per_file``
    cuts a session into files of so many rows (0: as few as there are).
    """
    columns = ("session_date", "snap_ts", "contract", "strike", "call_vol", "put_vol")
    tape.select(*columns).sortWithinPartitions("session_date", "snap_ts").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file) \
        .partitionBy("session_date").parquet(path)


def replace_table(df: DataFrame, path: str, attempts: int = 10) -> int:
    """Full replace of a table in one step (``versions``); the rows written. ``read_table`` reads it."""
    versions = Versions(df.sparkSession, path)
    folder, seen = versions.new_folder(), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{versions.path}/{folder}")
    rows = seen.get["rows"]
    for _ in range(attempts):
        number, _ = versions.latest()
        if versions.publish(number + 1, {"parts": {"all": {"folder": folder, "rows": rows}}, "schema": df.schema.json()}):
            return rows
    raise ConflictError(f"{path}: {attempts} commits were overtaken")


def write_payload(payload: DataFrame, path: str, by_session: bool = True) -> None:
    """One JSON document per session, below its session_date folder.

    For thousands of sessions at once, ``by_session=False`` writes plain JSON lines instead
    of one small file per session.
    """
    writer = payload.write.mode("overwrite").option("ignoreNullFields", False)
    if by_session:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("session_date")
    writer.json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Report lines in order, one folder per session."""
    report.repartition("session_date").sortWithinPartitions("session_date", "section", "ord") \
        .select("session_date", "line").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("session_date").text(path)
