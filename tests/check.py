"""Run registered queries against DuckDB: ``python -m tests.check [sf] [name ...]``."""

import sys
import time
import traceback

sys.path.insert(0, ".")

import __spark_entry__ as entry
from supportkb.session import local_session
from tests.harness import compare

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    spark = local_session()
    qs, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(qs)
    bad = 0
    t0 = time.time()
    for n in names:
        try:
            r = compare(spark, f"/root/testdata/{sf}", n, qs[n], oracle.get(n))
        except Exception as e:
            traceback.print_exc(limit=-3) if len(names) < 3 else None
            r = {"name": n, "status": "ERROR", "detail": str(e)[:1500]}
        bad += r["status"] not in ("ok", "rows-only")
        print({k: v for k, v in r.items() if k != "detail"}, flush=True)
        if "detail" in r:
            print("  ", r["detail"], flush=True)
    print(f"{len(names)} queries, {bad} bad, {time.time() - t0:.0f}s")
