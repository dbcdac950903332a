"""python tests/check.py [sf_dir] [name ...]: compare registered queries with their SQL."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from talkloom.session import build_session  # noqa: E402
from tests.compare import compare, duck  # noqa: E402


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in [n for n in queries if not argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv[1:])]:
        t = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, sf, queries[name], sqls[name])
            else:
                n = queries[name](spark, sf).count()
                msg = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:1800]}"
        took = time.time() - t
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {took:.1f}s{'' if name in sqls else ' (rows only)'}"
              + (f"\n     {msg}" if msg else ""), flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
