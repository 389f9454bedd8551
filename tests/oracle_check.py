"""Compare the named queries with their SQL; usage: oracle_check.py SF_DIR [name ...]."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if equal, else what differs (values must agree exactly, types up to integer width)."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        if got[c].dtype != want[c].dtype:
            return f"type of {c}: {got[c].dtype} / {want[c].dtype}"
        bad = (got[c] != want[c]) & ~(got[c].isna() & want[c].isna())
        if bad.any():
            return f"{int(bad.sum())} values of {c}, first {got[c][bad].iloc[0]!r} / {want[c][bad].iloc[0]!r}"
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    assert not set(sql) - set(queries), set(sql) - set(queries)
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            mid = time.time()
            if name not in sql:
                print(f"{name:28} rows only {len(got)} ({mid - start:.1f}s)", flush=True)
                continue
            problem = difference(got, con.sql(sql[name]).df())
            print(f"{name:28} {problem or 'ok'} {len(got)} ({mid - start:.1f}s, sql {time.time() - mid:.1f}s)", flush=True)
            failed += problem is not None
        except Exception as e:
            failed += 1
            print(f"{name:28} ERROR {str(e)[:600]}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
