"""Tape files that grow while they are followed, and the same files read at once."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.sizing import shared_folder
from tidemark.operators.tape import window_slots
from tidemark.sources.delimited import read_delimited
from tidemark.sources.following import follow_delimited
from tidemark.sources.market import follow_tape, read_tape
from tidemark.streaming import capture as L

HEADER = "timestamp,contract,strike,call_vol,put_vol\n"
DAYS = ("2026-06-17", "2026-06-18")


def tape_lines(day, seed):
    """Polls of a night and a day, cumulative; the evening before first."""
    draw = random.Random(seed)
    clock = [f"2026-06-{int(day[-2:]) - 1:02d} 21:0{m}:00" for m in range(3)] + [f"{day} {h:02d}:{m:02d}:10" for h in (2, 6, 7, 9, 12, 14, 15) for m in (0, 30)]
    total, out = {}, []
    for ts in clock:
        for contract in ("CTZ6", "CTH7", "CTN6", "XX1"):
            if draw.random() < 0.85:
                for strike in (60, 70):
                    total[contract, strike] = total.get((contract, strike), 0) + draw.randrange(5)
                    out.append(f"{ts},{contract},{strike},{total[contract, strike]},{draw.randrange(3)}\n")
    return out


def append(path, text):
    path.parent.mkdir(exist_ok=True)
    with open(path, "ab") as f:
        f.write(text.encode())


def windows(df):
    return sorted(tuple(r) for r in df.select("session_date", "window", "generic_code", "call", "put", "total").collect())


def test_windows_after_each_of_three_steps_with_restarts(spark, tmp_path):
    """Every step is a new query on the folder of the one before, so its offsets come from the checkpoint."""
    folder = shared_folder(spark)
    files = {d: (tmp_path / d / "ct_options_tape.csv", tape_lines(d, k)) for k, d in enumerate(DAYS)}
    steps = ((0.3, 0.0), (0.61, 0.2), (1.0, 1.0))  # the second session appears in the second step
    done = dict.fromkeys(DAYS, 0)
    for k, shares in enumerate(steps):
        for d, share in zip(DAYS, shares):
            path, lines = files[d]
            if share and not done[d]:
                append(path, HEADER)
            upto = int(len(lines) * share)
            append(path, "".join(lines[done[d]:upto]))
            done[d] = upto
        if k == 1:  # the last line is still being written
            append(files[DAYS[0]][0], files[DAYS[0]][1][done[DAYS[0]]][:-4])
        got = windows(L.live_option_windows(follow_tape(spark, str(tmp_path)), folder=folder))
        batch = read_tape(spark, str(tmp_path))
        if k == 1:  # the batch reads the cut line, too
            last = files[DAYS[0]][1][done[DAYS[0]]].split(",")
            cut = (F.col("snap_ts").cast("string") == last[0]) & (F.col("contract") == last[1]) & (F.col("strike") == float(last[2]))
            batch = batch.filter(~(cut & (F.col("session_date") == F.lit(DAYS[0]).cast("date"))))
            with open(files[DAYS[0]][0], "rb+") as f:  # the writer goes on where it stopped
                f.truncate(files[DAYS[0]][0].stat().st_size - len(files[DAYS[0]][1][done[DAYS[0]]][:-4]))
        assert got == windows(window_slots(batch)) and got
    rows = spark.read.parquet(f"{folder}/rows")
    assert rows.select("batch").distinct().count() >= 3


def emitted(spark, path, columns, folder, **how):
    out = L.run_available(follow_delimited(spark, path, columns, **how), mode="append", folder=folder)
    return [r for r in out.orderBy("file_path", "seq").collect()]


def test_each_line_once_and_only_complete_ones(spark, tmp_path):
    folder, path = shared_folder(spark), tmp_path / "a.csv"
    append(path, "x,y")
    assert emitted(spark, f"{tmp_path}/*.csv", ["y", "z"], folder) == []
    append(path, "\n1,2\n3,")
    assert [r.y for r in emitted(spark, f"{tmp_path}/*.csv", ["y", "z"], folder)] == ["2"]
    append(path, "4\n")
    append(tmp_path / "b.csv", '﻿"z", y ,x\r\nA,"é, ""q""",B\r\n,,\r\n')
    got = emitted(spark, f"{tmp_path}/*.csv", ["y", "z"], folder)
    assert [(r.y, r.z) for r in got] == [("2", None), ("4", None), ('é, "q"', "A"), (None, None)]
    assert [(r.y, r.z) for r in emitted(spark, f"{tmp_path}/*.csv", ["y", "z"], folder)] == [(r.y, r.z) for r in got]


def test_pieces_hold_every_line_once(spark, tmp_path):
    draw = random.Random(1)
    lines = [f"{i},{'v' * draw.randrange(30)}" for i in range(500)]
    for size in (1, 7, 64, 1000):
        folder, base = shared_folder(spark), tmp_path / str(size)
        append(base / "a.csv", "id,v\n" + "\n".join(lines[:300]) + "\n")
        if size == 1:
            append(base / "a.csv", "")
        first = emitted(spark, f"{base}/a.csv", ["id", "v"], folder, chunk=max(size, 40))
        append(base / "a.csv", "\n".join(lines[300:]) + "\n")
        both = emitted(spark, f"{base}/a.csv", ["id", "v"], folder, chunk=max(size, 40))
        assert [int(r.id) for r in first] == list(range(300)) and [f"{r.id},{r.v or ''}" for r in both] == lines


def test_lines_that_do_not_fit_are_kept_as_in_the_batch(spark, tmp_path):
    append(tmp_path / "a.csv", "x,y,z\n1,2,3\n4,5\n6,7,8,9\n\n10,11,12\n")
    got = emitted(spark, f"{tmp_path}/a.csv", ["x", "y", "z"], shared_folder(spark))
    want = read_delimited(spark, f"{tmp_path}/a.csv", ["x", "y", "z"]).collect()
    key = "_corrupt_record"
    assert sorted((r.x, r.y, r.z or "", r[key] or "") for r in got) == sorted((r.x, r.y, r.z or "", r[key] or "") for r in want)


def test_a_file_that_shrinks_raises(spark, tmp_path):
    folder, path = shared_folder(spark), tmp_path / "a.csv"
    append(path, "x\n1\n2\n")
    emitted(spark, str(path), ["x"], folder)
    path.write_text("x\n1\n")
    with pytest.raises(Exception, match="shorter"):
        emitted(spark, str(path), ["x"], folder)


def test_same_rows_as_a_csv_reader(spark, tmp_path):
    draw = random.Random(5)
    with open(tmp_path / "a.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["a", "b"])
        for _ in range(300):
            out.writerow([draw.choice(["", "x", 'q"q', "a,b", " s "]), draw.choice(["1", "é", "", "'"])])
    got = emitted(spark, f"{tmp_path}/a.csv", ["a", "b"], shared_folder(spark), chunk=500)
    with open(tmp_path / "a.csv", newline="") as f:
        assert [(r.a or "", r.b or "") for r in got] == [(r["a"], r["b"]) for r in csv.DictReader(f)]
