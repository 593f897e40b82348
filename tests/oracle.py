"""Side-by-side check of registered queries against their DuckDB text.

Run ``python tests/oracle.py sf_dir [name ...]``; the tests use ``compare``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from fairline.session import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        if math.isnan(value):
            return "~"
        if value == int(value):
            return str(int(value))
        return repr(round(value, 6))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark_df, con, sql):
    left, left_columns = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right, right_columns = rows_of(names, cursor.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}", len(left)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}", len(left)
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}", len(left)
    return None, len(left)


def main(argv):
    from fairline.catalog import ORACLES, QUERIES
    from fairline.session import local_session

    sf_dir, names = argv[0], argv[1:]
    chosen = [q for q in QUERIES if not names or any(q.startswith(n) for n in names)]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem, count = compare(frame, con, ORACLES[name])
            else:
                problem, count = None, len(frame.collect())
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += problem is not None
        kind = "oracle" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok'} {name} {kind} {count} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
