"""``python tests/check.py [folder] [name ...]``: compare queries with their SQL and time them."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from folio_spark.session import local_session  # noqa: E402

args = sys.argv[1:]
folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
spark = local_session(8, **{"spark.sql.shuffle.partitions": "8"})
queries, sql = entry.queries(), entry.oracle_sql()
names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
bad = []
for name in names:
    start = time.time()
    try:
        rows, problem = compare(spark, name, queries[name], sql.get(name), folder)
    except Exception as e:  # noqa: BLE001
        rows, problem = -1, str(e)[:1500]
    note = "ok" if problem is None else "FAIL"
    print(f"{note:5}{name:28}{rows:9} rows {time.time() - start:7.2f}s{'' if name in sql else '  (rows only)'}", flush=True)
    if problem:
        bad.append(name)
        print("   ", problem, flush=True)
print(f"{len(names) - len(bad)} of {len(names)} ok; failed: {bad}")
