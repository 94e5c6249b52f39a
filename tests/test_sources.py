import pytest
from builders import write_csv
from pyspark.sql import functions as F

from tidemark.operators.upsert import merge_counts, upsert
from tidemark.sources import delimited
from tidemark.sources.delimited import quarantine, read_delimited
from tidemark.sources.market import flatten_history, prior_series, read_history
from tidemark.sources.sinks import ConflictError, HistoryTable, replace_table, write_report
from tidemark.sources.versions import read_table


def test_headers_in_different_order_are_read_by_name(spark, tmp_path):
    write_csv(tmp_path / "a" / "x.csv", ["t", "c", "v"], [["1", "A", "10"], ["2", "B", "20"]])
    write_csv(tmp_path / "b" / "x.csv", ["v", "t", "extra", "c"], [["30", "3", "e", "C"]])
    write_csv(tmp_path / "c" / "x.csv", ["c", "t"], [["D", "4"]])
    df = read_delimited(spark, f"{tmp_path}/*/x.csv", ["t", "c", "v"])
    assert sorted((r.t, r.c, r.v) for r in df.collect()) == [("1", "A", "10"), ("2", "B", "20"), ("3", "C", "30"), ("4", "D", None)]
    assert quarantine(df).count() == 0


def test_one_header_is_one_plain_scan(spark, tmp_path):
    for i in range(3):
        write_csv(tmp_path / f"s{i}" / "x.csv", ["t", "c"], [[i, "A"]])
    df = read_delimited(spark, f"{tmp_path}/*/x.csv", ["c", "t", "nope"])
    assert sorted((r.t, r.c, r.nope) for r in df.collect()) == [("0", "A", None), ("1", "A", None), ("2", "A", None)]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_short_and_long_rows(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("t,c,v\n1,A,10\n2,B\n3,C,30,99\n4,D,40")
    df = read_delimited(spark, str(p), ["t", "c", "v"]).cache()
    assert [(r.t, r.c, r.v) for r in df.orderBy("t").collect()] == [("1", "A", "10"), ("2", "B", None), ("3", "C", "30"), ("4", "D", "40")]
    bad = quarantine(df).collect()
    assert {r._corrupt_record for r in bad} == {"2,B", "3,C,30,99"} and all("x.csv" in r.file_path for r in bad)


def test_row_order_is_kept(spark, tmp_path):
    p = write_csv(tmp_path / "x.csv", ["k", "v"], [["a", i] for i in range(5000)])
    df = read_delimited(spark, p, ["k", "v"])
    assert df.groupBy("k").agg(F.max_by("v", "seq").alias("v")).first().v == "4999"


def test_missing_source_policies(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing.csv"):
        read_delimited(spark, f"{tmp_path}/nothing.csv", ["a"])
    assert read_delimited(spark, f"{tmp_path}/nothing.csv", ["a"], missing="empty").count() == 0


KEYS = ("date", "commodity")
SCHEMA = "date date, commodity string, total double, note string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), "date string, commodity string, total double, note string").withColumn(
        "date", F.col("date").cast("date"))


def test_history_table_is_idempotent_and_permanent(spark, tmp_path):
    t = HistoryTable(spark, f"{tmp_path}/h", SCHEMA, KEYS)
    assert t.rows().count() == 0
    t.upsert(rows(spark, ("2025-12-31", "CT", 1.0, "a"), ("2026-01-02", "CT", 2.0, "b")))
    t.upsert(rows(spark, ("2026-01-02", "CT", 999.0, None)))
    t.upsert(rows(spark, ("2026-01-02", "KC", 5.0, "k"), ("2026-01-05", "CT", 3.0, "c")))
    got = sorted((str(r.date), r.commodity, r.total, r.note) for r in t.rows().collect())
    assert got == [("2025-12-31", "CT", 1.0, "a"), ("2026-01-02", "CT", 999.0, None), ("2026-01-02", "KC", 5.0, "k"), ("2026-01-05", "CT", 3.0, "c")]
    t.upsert(rows(spark, ("2026-01-05", "CT", None, "new")), merge="coalesce")
    last = t.rows().filter("date = date'2026-01-05'").first()
    assert (last.total, last.note) == (3.0, "new")
    t.export_csv(f"{tmp_path}/csv", {"total": 2})
    text = spark.read.option("header", True).csv(f"{tmp_path}/csv").filter("date = '2026-01-02' and commodity = 'CT'").first()
    assert text.total == "999.00"


def test_an_upsert_rewrites_only_the_years_it_touches(spark, tmp_path):
    t = HistoryTable(spark, f"{tmp_path}/h", SCHEMA, KEYS)
    t.upsert(rows(spark, ("2024-05-01", "CT", 1.0, "a"), ("2025-05-01", "CT", 2.0, "b")))
    before = t.versions.latest()[1]["parts"]
    t.upsert(rows(spark, ("2025-05-02", "CT", 3.0, "c")))
    after = t.versions.latest()[1]["parts"]
    assert after["2024"] == before["2024"] and after["2025"]["folder"] != before["2025"]["folder"]
    assert t.rows().count() == 3


def of(table):
    return sorted((str(r.date), r.commodity, r.total, r.note) for r in table.rows().collect())


def other_first(monkeypatch, table, other, times=1):
    """Let ``other`` commit just before ``table`` publishes."""
    publish, left = table.versions.publish, [times]

    def late(number, manifest):
        if left[0]:
            left[0] -= 1
            other(left[0])
        return publish(number, manifest)

    monkeypatch.setattr(table.versions, "publish", late)


def test_of_two_writers_of_one_year_one_begins_again(spark, tmp_path, monkeypatch):
    a, b = (HistoryTable(spark, f"{tmp_path}/h", SCHEMA, KEYS) for _ in range(2))
    a.upsert(rows(spark, ("2026-01-01", "CT", 1.0, "first")))
    other_first(monkeypatch, a, lambda k: b.upsert(rows(spark, ("2026-01-02", "CT", 2.0, "b"), ("2026-01-03", "CT", 3.0, "b"))))
    counts = a.upsert(rows(spark, ("2026-01-03", "CT", 9.0, "a"), ("2026-01-04", "CT", 4.0, "a")))
    assert of(a) == [("2026-01-01", "CT", 1.0, "first"), ("2026-01-02", "CT", 2.0, "b"), ("2026-01-03", "CT", 9.0, "a"), ("2026-01-04", "CT", 4.0, "a")]
    assert counts == {"n_new": 2, "n_kept": 2, "n_total": 4} and a.versions.numbers() == [1, 2, 3]


def test_writers_of_different_years_do_not_merge_again(spark, tmp_path, monkeypatch):
    a, b = (HistoryTable(spark, f"{tmp_path}/h", SCHEMA, KEYS) for _ in range(2))
    a.upsert(rows(spark, ("2026-01-01", "CT", 1.0, "first")))
    other_first(monkeypatch, a, lambda k: b.upsert(rows(spark, (f"202{k}-01-02", "CT", 2.0, "b"))), times=2)
    merged = []
    write = a._written
    monkeypatch.setattr(a, "_written", lambda *x: merged.append(1) or write(*x))
    assert a.upsert(rows(spark, ("2026-01-03", "CT", 9.0, "a")))["n_total"] == 4
    assert len(merged) == 1 and [r[0] for r in of(a)] == ["2020-01-02", "2021-01-02", "2026-01-01", "2026-01-03"]


def test_a_writer_that_is_always_late_gives_up(spark, tmp_path, monkeypatch):
    a, b = (HistoryTable(spark, f"{tmp_path}/h", SCHEMA, KEYS) for _ in range(2))
    other_first(monkeypatch, a, lambda k: b.upsert(rows(spark, (f"20{k + 10}-01-02", "CT", 2.0, "b"))), times=3)
    with pytest.raises(ConflictError):
        a.upsert(rows(spark, ("2026-01-03", "CT", 9.0, "a")), attempts=2)
    assert len(of(a)) == 2


def test_a_run_killed_before_its_commit_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = HistoryTable(spark, f"{tmp_path}/h", SCHEMA, KEYS)
    t.upsert(rows(spark, ("2025-12-31", "CT", 1.0, "a"), ("2026-01-02", "CT", 2.0, "b")))
    before, read = of(t), t.rows()

    def killed(number, manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(t.versions, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        t.upsert(rows(spark, ("2025-12-31", "CT", 8.0, "x"), ("2026-01-02", "CT", 9.0, "x")))
    fresh = HistoryTable(spark, f"{tmp_path}/h", SCHEMA, KEYS)
    assert of(fresh) == before and read.count() == 2
    assert len(list((tmp_path / "h" / "_data").iterdir())) == 2  # the files of the killed run name nothing
    assert fresh.versions.expire(older_than=0) == 1 and of(fresh) == before


def test_readers_keep_their_version_until_it_expires(spark, tmp_path):
    t = HistoryTable(spark, f"{tmp_path}/h", SCHEMA, KEYS)
    for total in (1.0, 2.0, 3.0):
        t.upsert(rows(spark, ("2026-01-02", "CT", total, "a")))
        if total == 1.0:
            old = t.rows()
    assert old.first().total == 1.0 and t.rows().first().total == 3.0
    assert t.versions.expire(keep=1, older_than=3600) == 0 and t.versions.expire(keep=1, older_than=0) == 2
    assert t.versions.numbers() == [3] and of(t) == [("2026-01-02", "CT", 3.0, "a")]


def test_a_history_of_year_folders_is_taken_over(spark, tmp_path):
    old = rows(spark, ("2025-12-31", "CT", 1.0, "a"), ("2026-01-02", "CT", 2.0, "b"), (None, "CT", 0.0, "n"))
    old.withColumn("year", F.year("date")).write.partitionBy("year").parquet(f"{tmp_path}/h")
    t = HistoryTable(spark, f"{tmp_path}/h", SCHEMA, KEYS)
    assert len(of(t)) == 3
    assert t.upsert(rows(spark, ("2026-01-02", "CT", 5.0, "c"))) == {"n_new": 1, "n_kept": 2, "n_total": 3}
    assert of(t) == [("2025-12-31", "CT", 1.0, "a"), ("2026-01-02", "CT", 5.0, "c"), ("None", "CT", 0.0, "n")]
    t.upsert(rows(spark, (None, "KC", 7.0, "m")))
    assert len(of(t)) == 4 and t.upsert(rows(spark)) == {"n_new": 0, "n_kept": 4, "n_total": 4}


def test_counts_are_those_of_the_merge(spark, tmp_path):
    t = HistoryTable(spark, f"{tmp_path}/h", SCHEMA, KEYS)
    old = rows(spark, *[(f"2025-01-{d:02d}", c, 1.0, "o") for d in range(1, 29) for c in ("CT", "KC")], ("2024-02-01", "CT", 1.0, "o"))
    new = rows(spark, *[(f"2025-01-{d:02d}", "CT", 2.0, "n") for d in range(20, 32)])
    t.upsert(old)
    want = merge_counts(old, new, KEYS).first()
    assert t.upsert(new) == want.asDict()
    assert t.upsert(new.withColumn("total", F.lit(None).cast("double")), merge="coalesce")["n_total"] == want.n_total
    assert t.rows().filter("total = 2.0").count() == 12


def test_replaced_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert replace_table(spark.range(5), path) == 5
    before = read_table(spark, path)
    assert replace_table(spark.range(2).selectExpr("id AS other"), path) == 2
    assert before.count() == 5 and read_table(spark, path).columns == ["other"] and read_table(spark, path).count() == 2
    spark.range(3).write.parquet(f"{tmp_path}/plain")
    assert read_table(spark, f"{tmp_path}/plain").count() == 3 and read_table(spark, f"{tmp_path}/none", "id long").count() == 0


def test_upsert_ignores_unknown_columns_and_counts(spark):
    old = rows(spark, ("2026-01-01", "CT", 1.0, "a"), ("2026-01-02", "CT", 2.0, "b"))
    new = rows(spark, ("2026-01-02", "CT", 9.0, "z"), ("2026-01-03", "CT", 3.0, "c")).withColumn("extra", F.lit(1))
    out = upsert(old, new, KEYS)
    assert out.columns == old.columns and sorted(r.total for r in out.collect()) == [1.0, 3.0, 9.0]
    c = merge_counts(old, new, KEYS).first()
    assert (c.n_new, c.n_kept, c.n_total) == (2, 1, 3)


def test_history_reader(spark, tmp_path):
    assert read_history(spark, f"{tmp_path}/none", SCHEMA, "ct").count() == 0
    df = spark.createDataFrame([("2026-01-02", "ct", "12.50"), ("2026-01-03", "CT", ""), ("2026-01-04", "KC", "7")],
                               "date string, commodity string, night_total string")
    assert [r.value for r in prior_series(df, "night_total", "CT").collect()] == [12.5]
    replace_table(df, f"{tmp_path}/t")
    replace_table(df.limit(1), f"{tmp_path}/t")
    assert read_history(spark, f"{tmp_path}/t", SCHEMA, "CT").count() == 1


def test_flatten_history(spark):
    nested = spark.createDataFrame(
        [("CTDEC1 future", [("2026-06-16", 34000.0, None), (None, 1.0, 1.0), ("2026-06-17", None, 5.0)])],
        "security string, fieldData array<struct<date:string,DAY_VOLUME:double,OI:double>>")
    got = [(str(r.session_date), r.generic, r.ticker, r.volume, r.open_int, r.px_last)
           for r in flatten_history(nested, {"volume": "DAY_VOLUME", "open_int": "OI"}, " future").orderBy("session_date").collect()]
    assert got == [("2026-06-16", "CTDEC1", "CTDEC1 future", 34000.0, None, None), ("2026-06-17", "CTDEC1", "CTDEC1 future", None, 5.0, None)]


def test_report_sink_keeps_line_order(spark, tmp_path):
    df = spark.range(50).selectExpr("date'2026-06-17' session_date", "1 section", "cast(id as int) ord", "concat('line ', id) line")
    write_report(df.repartition(8), f"{tmp_path}/r")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == [f"line {i}" for i in range(50)]


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n):
        part = self.data[self.at:self.at + n]
        self.at += len(part)
        return part


def test_a_header_costs_one_block_whatever_the_size_of_the_file():
    first_line = delimited.line_reader()[0]
    for body in (b"", b"x" * 10, b"1,2\n" * 1_000_000):
        file = Counted(b"a,b\r\n" + body)
        assert first_line(file) == b"a,b" and file.at <= 1 << 13
    wide = b",".join(b"c%d" % i for i in range(5000))
    assert first_line(Counted(wide + b"\n1")) == wide and first_line(Counted(wide)) == wide and first_line(Counted(b"")) == b""


def test_both_ways_to_read_headers_agree(spark, tmp_path):
    for i, text in enumerate(("a,b\n1,2\n", "\ufeffa, \"b\"\r\n3,4\r\n", "only", "", "é,b\n")):
        folder = tmp_path / f"d {i}=x%20y"
        folder.mkdir()
        (folder / "x.csv").write_text(text, newline="")
    path = f"{tmp_path}/*/x.csv"
    listed, scanned = (sorted(map(tuple, f(spark, path).collect())) for f in (delimited._listed_lines, delimited._scanned_lines))
    assert [(p, v.rstrip("\r")) for p, v in scanned] == [(p, v.lstrip("\ufeff")) for p, v in listed] and len(listed) == 4
    found = {r.file_path.split("/")[-2][4:5]: r.header for r in delimited.headers(spark, path).collect()}
    assert sorted(found.values()) == [["a", "b"], ["a", "b"], ["only"], ["é", "b"]]


def test_stores_that_only_spark_opens(spark):
    assert not delimited._openable("viewfs://cluster/x") and delimited._openable("/x") and delimited._openable("hdfs://a/b") and delimited._openable("file:/x")
