"""Run registered queries against their SQL twins: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402

from tidemark.session import local_session  # noqa: E402


def main() -> None:
    sf, *names = sys.argv[1:] or ["0.01"]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    assert not set(sql) - set(queries), set(sql) - set(queries)
    bad = 0
    for name, q in queries.items():
        if names and name not in names:
            continue
        t = time.time()
        spark_time = 0.0
        try:
            df = q(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            spark_time = time.time() - t
            if name in sql:
                msg = compare(df.columns, rows, con, sql[name])
            else:
                msg = "" if rows else "no rows"
        except Exception as e:  # keep going: this is a report
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(msg)
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if msg else 'ok  '} {kind} {name:24s} {spark_time:6.1f}s + {time.time() - t - spark_time:5.1f}s {msg}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
