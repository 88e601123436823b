"""Run queries in Spark and their SQL in DuckDB and compare whole results.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TOL = 2e-6
SPENT: dict[str, float] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(v):
    if v is None:
        return (0, 0)
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, (int, float)):
        return (1, -1e300 if isinstance(v, float) and math.isnan(v) else v)
    return (2, str(v))


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return a == b or abs(a - b) <= TOL
    return a == b or str(a) == str(b)


def family(t: str) -> str:
    t = t.lower()
    if any(k in t for k in ("list", "array", "[")):
        return "list"
    if any(k in t for k in ("int", "long", "short")):
        return "int"
    return "float" if any(k in t for k in ("double", "float", "decimal")) else t.replace("varchar", "string")


def compare(df, con, sql: str) -> str | None:
    """None when equal, else the first difference."""
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.select(*cols).toLocalIterator()),
                 key=lambda r: [_key(v) for v in r])
    SPENT["spark"] = time.time()
    rel = con.sql(sql)
    names = rel.columns
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    kinds = {c: family(t) for c, t in df.dtypes}
    for n, t in zip(names, rel.types):
        if family(str(t)) != kinds[n] or "HUGE" in str(t) or "DECIMAL" in str(t):
            return f"type of {n}: {dict(df.dtypes)[n]} != {t}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=lambda r: [_key(v) for v in r])
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    exact = 0
    for a, b in zip(got, want):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"row {a} != {b}"
        exact += a != b
    return None if not exact else f"NEAR {exact} of {len(got)} rows differ below {TOL}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = e.queries(), e.oracle_sql()
    picked = sys.argv[2:]
    names = [n for n in queries if not picked or any(n.startswith(p) for p in picked)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf)
            if n in oracles:
                diff = compare(df, con, oracles[n])
                rows = f" (spark {SPENT.get('spark', t) - t:.1f}s)"
            else:
                diff, rows = None, f" rows={df.count()} (no SQL)"
        except Exception as ex:  # report and go on
            diff, rows = f"{type(ex).__name__}: {str(ex)[:600]}", ""
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {n} {time.time() - t:.1f}s{rows} {diff or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
