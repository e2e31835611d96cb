"""Run reports against their SQL: ``python check.py [--sf DIR] [name-prefix ...]``."""

from __future__ import annotations

import sys
import time

from tests.oracle import connect, difference, spark_rows, sql_rows
from tokenloom.plans.catalog import REPORTS
from tokenloom.session import build_session


def main(argv: list[str]) -> int:
    path = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        path = argv[i + 1]
        del argv[i : i + 2]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    failed = []
    for name, rep in REPORTS.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        try:
            got = spark_rows(rep(spark, path))
            t1 = time.time()
            if rep.sql is None:
                msg, t2 = "", t1
                note = f"rows-only {len(got[1])}"
            else:
                want = sql_rows(con, rep.sql)
                t2 = time.time()
                msg = difference(got, want)
                if msg:
                    near = difference(got, want, 1e-9)
                    msg = ("NEAR " if not near else "") + msg
                note = f"{len(got[1])} rows"
        except Exception as e:  # noqa: BLE001
            t1 = t2 = time.time()
            msg, note = f"{type(e).__name__}: {str(e)[:900]}", ""
        print(f"{'ok  ' if not msg else 'FAIL'} {name:34s} spark {t1 - t0:5.2f}s sql {t2 - t1:5.2f}s {note} {msg}", flush=True)
        if msg:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
