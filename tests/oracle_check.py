"""Run registered queries in Spark and in DuckDB on the same files and compare them.

    python tests/oracle_check.py [data_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rangeloom.plans import catalog  # noqa: E402,F401
from rangeloom.plans.registry import ORACLES, QUERIES  # noqa: E402
from rangeloom.plans.views import BASE_TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, str]:
    """('ok' | 'rows' | 'FAIL', detail)."""
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    t1 = time.time()
    if name not in ORACLES:
        return ("rows" if got else "FAIL"), f"{len(got)} rows, no oracle"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != cols:
        return "FAIL", f"columns {cols} vs {sorted(names)}"
    pick = [names.index(c) for c in cols]
    want = sorted(tuple(_cell(r[i]) for i in pick) for r in cur.fetchall())
    if got != want:
        odd = [g for g in got if g not in set(want)][:3], [w for w in want if w not in set(got)][:3]
        return "FAIL", f"{len(got)} vs {len(want)} rows; spark only {odd[0]}; duckdb only {odd[1]}"
    wide = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema]
    bad = [t for t in types if wide.get(t[1], t[2]) != t[2]]
    return ("FAIL", f"types {bad}") if bad else ("ok" if got else "FAIL", f"{len(got)} rows; duckdb {time.time() - t1:.1f}s")


def main() -> int:
    from rangeloom.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a] or list(QUERIES)
    spark = build_session("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for n in [q for q in QUERIES if any(q == a or q.startswith(a) for a in names)]:
        t0 = time.time()
        try:
            state, detail = compare(spark, con, sf_dir, n)
        except Exception as e:  # noqa: BLE001
            state, detail = "FAIL", f"{type(e).__name__}: {str(e)[:600]}"
        bad += state == "FAIL"
        print(f"{state:5} {n:32} {time.time() - t0:6.2f}s  {detail}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
