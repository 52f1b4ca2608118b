"""Compare queries with their SQL on the same tables: python tests/oracle.py FOLDER [QUERY...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def connect(folder: str):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differences(spark, folder: str, name: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows in any order."""
    df = query(spark, folder)
    mine = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    res = connect(folder).execute(sql)
    cols = [c[0] for c in res.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    theirs = [tuple(plain(r[i]) for i in order) for r in res.fetchall()]
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    a, b = sorted(mine, key=repr), sorted(theirs, key=repr)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} rows against {len(b)}; only here {only[0]}, only there {only[1]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or qs:
        t = time.time()
        try:
            said = differences(spark, sys.argv[1], name, qs[name], sqls[name]) if name in sqls else f"no SQL; {qs[name](spark, sys.argv[1]).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
