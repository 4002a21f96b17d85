"""Run registered queries next to their SQL on DuckDB and compare the rows.

    python tests/check_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


TIMES: list[float] = [0.0, 0.0]


def norm(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted(value.asDict().items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(norm(r[i]) for i in order) for r in rows]


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else a short description of the difference."""
    from collections import Counter

    t0 = time.time()
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    TIMES[:] = [round(t1 - t0, 1), round(time.time() - t1, 1)]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = Counter(map(repr, got)), Counter(map(repr, want))
    if a == b:
        return None
    left, right = list((a - b).elements()), list((b - a).elements())
    return f"rows {len(got)} vs {len(want)}; spark only {len(left)} {sorted(left)[:2]}; sql only {len(right)} {sorted(right)[:2]}"


def main() -> int:
    import __spark_entry__ as entry
    from medialoom.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in args or queries:
        start = time.time()
        try:
            df = queries[key](spark, sf_dir)
            if key in oracles:
                diff = compare(df, con, oracles[key])
                count = ""
            else:
                diff, count = None, f"rows={len(df.collect())}"
            types = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema) if args else ""
        except Exception as exc:  # report and go on with the next key
            diff, count, types = f"{type(exc).__name__}: {str(exc)[:700]}", "", ""
        bad += diff is not None
        kind = "S" if key in oracles else "R"
        print(f"{'OK ' if diff is None else 'BAD'} {kind} {key} {time.time() - start:.1f}s {TIMES} {count} {types} {(diff or '')[:900]}", flush=True)
    print(f"{bad} of {len(args or queries)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
