"""python tests/check.py [sf folder] [query ...]: run queries against the SQL twins."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as entry  # noqa: E402
from oracle import connect, differences  # noqa: E402

from embedlake.session import build_session  # noqa: E402


def main(folder: str, wanted: list[str]) -> int:
    spark = build_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            if name in sql:
                problems = differences(frame, con, sql[name])
            else:
                problems = [] if frame.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        for problem in problems:
            print("     ", problem[:1500], flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    data = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(main(data, args))
