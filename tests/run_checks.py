"""Compare registered queries with their SQL: python tests/run_checks.py [sf] [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from compare import differences, duck  # noqa: E402
from textinsight import build_session  # noqa: E402


def main(argv):
    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.001'}"
    spark = build_session("checks", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = duck(sf_dir), E.oracle_sql()
    bad = 0
    for name, query in E.queries().items():
        if len(argv) > 1 and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = differences(spark, connection, query, sql[name], sf_dir)
            else:
                problem = "" if query(spark, sf_dir).count() else "no rows"
        except Exception as failure:
            problem = f"{type(failure).__name__}: {str(failure)[:700]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem[:900]}", flush=True)
    print(bad, "bad")


main(sys.argv[1:])
