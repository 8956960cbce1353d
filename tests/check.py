"""python tests/check.py [sf_dir] [name ...]: compare queries with their SQL."""

from __future__ import annotations

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402

from fleetlens.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, bad = local_session(8), connect(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                result = compare(run(spark, sf_dir), con, sql[name])
                note = result or "ok"
                n = con.execute(f"SELECT count(*) FROM ({sql[name]})").fetchall()[0][0]
            else:
                n, note = run(spark, sf_dir).count(), "ok (rows only)"
        except Exception as e:  # report and go on
            n, note = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not note.startswith("ok")
        print(f"{name:28s} {n:7d} {time.time() - start:6.1f}s  {note}", flush=True)
    print(f"{bad} bad", flush=True)
