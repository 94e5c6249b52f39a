"""Compare registered queries with their SQL: python tests/check_queries.py SF [name ...]"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import tempfile

from compare import connect, differences
from pyspark.sql import SparkSession

from __spark_entry__ import oracle_sql, queries


def main(sf, names):
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false") \
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", os.environ.get("CHECK_ZONE", "UTC")) \
        .config("spark.driver.memory", "8g") \
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-check-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sql = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in sql:
                diff = differences(df, con, sql[name])
            else:
                diff = []
                print(f"   rows only: {df.count()}")
        except Exception as exc:
            diff = [f"{type(exc).__name__}: {str(exc)[:900]}"]
        took = time.time() - start
        print(f"{'ok  ' if not diff else 'DIFF'} {name} {took:.1f}s", flush=True)
        for d in diff:
            print("   ", d)
        bad += bool(diff)
    print("failed:", bad)


if __name__ == "__main__":
    main(f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:])
