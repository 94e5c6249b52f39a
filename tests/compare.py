"""Row-by-row comparison of a Spark result with DuckDB on the same Parquet files."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    return str(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, normal(names, cur.fetchall())


def differences(df, con, sql):
    names, want = sql_rows(con, sql)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    got = spark_rows(df)
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}", f"spark {got[:2]}", f"sql {want[:2]}"]
    return [f"{sorted(names)}\n  spark {g}\n  sql   {w}" for g, w in zip(got, want) if g != w][:3]
