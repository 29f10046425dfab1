"""Run registered queries beside their SQL in DuckDB and compare the rows.

    python tools/check_oracle.py [sf_dir] [name ...]      a name may end in *
"""

from __future__ import annotations

import fnmatch
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from quotalens.queries import ORACLES, QUERIES, load_all  # noqa: E402
from quotalens.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    patterns = argv[2:] or ["*"]
    load_all()
    spark = local_session(8, 8)
    bad = []
    for name, run in QUERIES.items():
        if not any(fnmatch.fnmatch(name, p) for p in patterns):
            continue
        start = time.perf_counter()
        try:
            df = run(spark, sf)
            rows = [tuple(r) for r in df.collect()]
        except Exception as error:  # report and go on with the next query
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            bad.append(name)
            continue
        took = time.perf_counter() - start
        types = dict(df.dtypes)
        if name not in ORACLES:
            print(f"rows-only {name}: {len(rows)} rows {took:.1f}s", flush=True)
            if not rows:
                bad.append(name)
            continue
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        try:
            cursor = con.execute(ORACLES[name])
            names = [d[0] for d in cursor.description]
            kinds = {d[0]: str(d[1]) for d in cursor.description}
            expected = cursor.fetchall()
        except Exception as error:
            print(f"SQL ERROR {name}: {str(error)[:1500]}", flush=True)
            bad.append(name)
            continue
        a, left = table(df.columns, rows)
        b, right = table(names, expected)
        simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                  "date": "DATE", "timestamp": "TIMESTAMP"}
        odd = [(c, types[c], kinds.get(c)) for c in a if types[c] in simple and simple[types[c]] != kinds.get(c)]
        ok = a == b and left == right and rows
        note = f" TYPES {odd}" if odd else ""
        print(f"{'ok' if ok else 'DIFF'} {name}: {len(left)}/{len(right)} rows {took:.1f}s{note}", flush=True)
        if not ok or odd:
            bad.append(name)
        if not ok:
            print("  columns", a, b)
            lset, rset = set(left), set(right)
            print("  only spark", [r for r in left if r not in rset][:3], len(lset - rset))
            print("  only sql  ", [r for r in right if r not in lset][:3], len(rset - lset))
    print("bad:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
