"""Run the registered queries against their SQL and report differences: compare.py SF_DIR [name ...]"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
from bench import spread  # noqa: E402
from inkmeter.queries import ORACLES, QUERIES  # noqa: E402

TABLES = ("documents", "labels", "conversations", "events", "benchmark")


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for name in df.columns:
        if str(df[name].dtype).startswith("datetime"):
            df[name] = df[name].astype("datetime64[us]")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    dealt = spread(spark, sf_dir, 8)  # one small file would keep one core busy
    bad = 0
    for name in names or list(QUERIES):
        try:
            t0 = time.time()
            got = QUERIES[name](spark, dealt).toPandas()
            t1 = time.time()
            if name not in ORACLES:
                print(f"rows  {name} {len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(ORACLES[name]).df()
            t2 = time.time()
            a, b = canonical(got), canonical(want)
            if list(a.columns) != list(b.columns):
                verdict = f"columns {set(a.columns) ^ set(b.columns)}"
            elif len(a) != len(b):
                verdict = f"rows {len(a)} {len(b)}"
            else:
                diff = {n: int((~((a[n] == b[n]) | (a[n].isna() & b[n].isna()))).sum()) for n in a.columns}
                types = {n: (str(a[n].dtype), str(b[n].dtype)) for n in a.columns if str(a[n].dtype) != str(b[n].dtype)}
                diff = {k: v for k, v in diff.items() if v}
                verdict = ("" if not diff else f"values {diff}") + (f" types {types}" if types else "")
            bad += bool(verdict.strip())
            print(f"{'ok   ' if not verdict else 'DIFF '} {name} {len(a)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s {verdict}", flush=True)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name} {str(e)[:300]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
