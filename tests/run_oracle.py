"""python tests/run_oracle.py [DIR] [NAME...]: every query against its SQL."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from flowmill.session import local_session  # noqa: E402


def main(directory: str, names: list[str]) -> int:
    spark, con = local_session(8), oracle.connection(directory)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            if name in sql:
                diff, n = oracle.compare(queries[name](spark, directory), con, sql[name])
            else:
                diff, n = [], queries[name](spark, directory).count()
        except Exception as e:  # noqa: BLE001
            diff, n = [f"{type(e).__name__}: {str(e)[:600]}"], -1
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  ' if name in sql else 'rows'} {name} {n} rows {time.time() - began:.1f}s", *diff, sep="\n     " if diff else " ", flush=True)
    print(f"{bad} failed of {len(names or queries)}")
    return int(bad > 0)


if __name__ == "__main__":
    args = sys.argv[1:]
    where = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(main(where, args))
