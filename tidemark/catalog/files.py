"""Sources and sinks: the derived inputs are written as files and read back by the library.

Every query uses a new folder below the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import boundaries as bnd
from tidemark.catalog import options as opt
from tidemark.catalog.adapters import bars, rounded, sidecar, tape
from tidemark.catalog.bars import seed
from tidemark.catalog.registry import SQL, query
from tidemark.operators import boundary as B
from tidemark.operators.sizing import shared_folder
from tidemark.plans import futures as fut
from tidemark.plans import options as P
from tidemark.settings import BAR_COLUMNS, SIDECAR_COLUMNS
from tidemark.sources import landed, sinks
from tidemark.sources.market import clean_bars, read_bars, read_sidecar, read_tape


@query("csv_tape_totals", SQL["option_window_totals"])
def csv_tape_totals(spark, sf):
    """Tape files in one folder tree whose column layout changed on 16 January."""
    root = shared_folder(spark)
    # rebalancing gathers the rows of a session in few files and splits a session that is too large
    rows = tape(spark, sf).withColumn("timestamp", F.date_format("snap_ts", "yyyy-MM-dd HH:mm:ss")) \
        .hint("rebalance", "session_date")
    layouts = (("timestamp", "contract", "strike", "call_vol", "put_vol"),
               ("put_vol", "strike", "timestamp", "trade_flag", "call_vol", "contract"))
    changed = F.col("session_date") >= F.lit("2024-01-16").cast("date")
    for names, sessions in zip(layouts, (~changed, changed)):
        part = rows.filter(sessions).withColumn("trade_flag", F.lit("x"))
        part.select("session_date", *names).write.mode("append").partitionBy("session_date").option("header", True).csv(root)
    found = read_tape(spark, root, files="session_date=*/*.csv")
    return rounded(P.options_sessions(found).totals, "pc_ratio")


@query("csv_boundary_windows", SQL["boundary_windows"])
def csv_boundary_windows(spark, sf):
    root = shared_folder(spark)
    rows = sidecar(spark, sf).select(
        F.lit("t").alias("timestamp"), F.col("session_date").alias("date"), F.lit("CT").alias("commodity"), "contract",
        "boundary", "volume", F.lit(None).cast("double").alias("oi"), "session_date")
    rows.select(*SIDECAR_COLUMNS, "session_date").hint("rebalance", "session_date").write.partitionBy("session_date").option("header", True).csv(root)
    return B.boundary_windows(read_sidecar(spark, root, files="session_date=*/*.csv"))


@query("csv_bar_totals", SQL["seed_session_totals"])
def csv_bar_totals(spark, sf):
    root = shared_folder(spark)
    rows = bars(spark, sf).withColumn("date", F.col("session_date")).withColumn(
        "ticker", F.concat("generic", F.lit(" Comdty")))
    blank = [F.lit(None).cast("string").alias(c) for c in BAR_COLUMNS if c not in rows.columns]
    rows.select("*", *blank).select(*BAR_COLUMNS).write.option("header", True).csv(root)
    return fut.seed_totals(clean_bars(read_bars(spark, f"{root}/*.csv"))).withColumnRenamed("full", "full_volume")


@query("history_table_upserts", SQL["seed_ingest_sessions"])
def history_table_upserts(spark, sf):
    """Permanent history: a first write with outdated values, then the right rows twice."""
    table = sinks.HistoryTable(spark, shared_folder(spark), fut.HISTORY_SCHEMA, ("date", "commodity"))
    rows = fut.seed_ingest(seed(spark, sf), generated_at=opt.AT)[0]
    table.upsert(rows.withColumn("full_total", F.col("full_total") * 2).withColumn("source", F.lit("old")))
    table.upsert(rows)
    table.upsert(rows.filter(F.year("date") == 1996))
    return table.rows().drop("generated_at")


@query("report_text_files", f"SELECT session_date, line FROM ({SQL['options_report']}) r")
def report_text_files(spark, sf):
    root = shared_folder(spark)
    sinks.write_report(opt.run(spark, sf, settle=True).report, root)
    lines = spark.read.text(root)
    return lines.select(F.col("session_date").cast("date").alias("session_date"), F.col("value").alias("line"))


@query("payload_json_files", SQL["option_window_totals"])
def payload_json_files(spark, sf):
    """JSON payloads written per session and read back; totals unfolded again."""
    root = shared_folder(spark)
    payload = P.payload(opt.run(spark, sf, settle=True))
    sinks.write_payload(payload, root)
    docs = spark.read.schema(payload.schema).json(root)
    blocks = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"windows.{w}").alias("b"))
                                 for w in ("overnight", "day")])).alias("w")
    out = docs.select("session_date", blocks).filter(F.col("w.b").isNotNull()).select(
        "session_date", "w.window", "w.b.total", "w.b.call", "w.b.put", "w.b.pc_ratio", "w.b.snapshot_ts_start",
        "w.b.snapshot_ts")
    return rounded(out, "pc_ratio")


@query("landed_tape_totals", SQL["option_window_totals"])
def landed_tape_totals(spark, sf):
    """Tape stored as Parquet by session, then read with partition pruning and two-column scans."""
    root = shared_folder(spark)
    sinks.land(tape(spark, sf).hint("rebalance", "session_date"), root)
    landed = spark.read.parquet(root).withColumn("session_date", F.col("session_date").cast("date"))
    return rounded(P.options_sessions(landed).totals, "pc_ratio")


@query("marked_tape_totals", SQL["option_window_totals"])
def marked_tape_totals(spark, sf):
    """The same from the files that hold a poll of some window, found in the index of a landed tape."""
    root = shared_folder(spark)
    landed.land(tape(spark, sf).hint("rebalance", "session_date"), root, rows_per_file=50)
    return rounded(P.options_sessions(landed.read_marked(spark, root)).totals, "pc_ratio")


@query("futures_document_contracts", SQL["futures_contract_history"])
def futures_document_contracts(spark, sf):
    """Session documents written as JSON and read back; the contract map unfolded again."""
    root = shared_folder(spark)
    documents = fut.document(bnd.run(spark, sf, settle=True))
    sinks.write_payload(documents, root, by_session=False)
    docs = spark.read.schema(documents.schema).json(root)
    rows = docs.select(F.col("date").cast("date").alias("date"), "commodity",
                       F.explode("summary.per_contract").alias("generic_code", "c"))
    return rows.select("date", "commodity", "generic_code", "c.*")


@query("options_document_contracts", SQL["options_contract_history"])
def options_document_contracts(spark, sf):
    docs = P.document(opt.run(spark, sf, settle=True))
    parts = [docs.select("session_date", F.lit(w).alias("window"), F.explode(f"{w}.per_contract").alias("generic_code", "c"))
             for w in ("overnight", "day")]
    rows = parts[0].unionByName(parts[1])
    return rows.select("session_date", "window", "generic_code", "c.*")
