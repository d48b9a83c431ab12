"""Run registered queries beside their SQL twins in DuckDB and compare the values exactly.

    python tests/compare.py [sf_dir] [name or prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def make_spark(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabspark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
        return plain(v) if isinstance(v, float) else v
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return v


def canonical(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(pdf.columns)
    rows = [tuple(plain(v) for v in row) for row in pdf[names].itertuples(index=False, name=None)]
    return names, sorted(rows, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def same(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return float(a) == float(b)
    return a == b


def differences(got: pd.DataFrame, want: pd.DataFrame, show: int = 3) -> list[str]:
    (gn, gr), (wn, wr) = canonical(got), canonical(want)
    if gn != wn:
        return [f"columns {gn} != {wn}"]
    if len(gr) != len(wr):
        return [f"rows {len(gr)} != {len(wr)}"]
    gr = sorted(gr, key=lambda t: tuple((x is None, str(float(x)) if isinstance(x, (int, float)) else str(x)) for x in t))
    wr = sorted(wr, key=lambda t: tuple((x is None, str(float(x)) if isinstance(x, (int, float)) else str(x)) for x in t))
    bad = [(g, w) for g, w in zip(gr, wr) if not all(same(a, b) for a, b in zip(g, w))]
    return [f"{len(bad)} rows differ"] + [f"  spark {g}\n  duck  {w}" for g, w in bad[:show]] if bad else []


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    if argv and os.path.isdir(argv[0]):
        sf_dir, argv = argv[0], argv[1:]
    spark, con = make_spark(), make_duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t0 = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - t0
            t0 = time.time()
            if name in oracle:
                problems = differences(got, con.execute(oracle[name]).df())
            else:
                problems = []
            state = "ok  " if name in oracle and not problems else ("rows" if not problems else "FAIL")
        except Exception as e:  # noqa: BLE001
            took, got, state, problems = time.time() - t0, [], "ERR ", [str(e)[:1500]]
        failed += state in ("FAIL", "ERR ")
        print(f"{state} {name:34s} rows={len(got):6d} spark={took:6.2f}s duck={time.time() - t0:5.2f}s", flush=True)
        for p in problems:
            print("   ", p, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
