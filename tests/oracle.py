"""Runs registered queries and their SQL side by side.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark_rows, spark_names, sql_rows, sql_names) -> str | None:
    """None when both results agree, else a short reason."""
    if sorted(spark_names) != sorted(sql_names):
        return f"columns {sorted(set(spark_names) ^ set(sql_names))}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    a, b = rows_of(spark_rows, spark_names), rows_of(sql_rows, sql_names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        names = sorted(spark_names)
        x, y = bad[0]
        diff = [(n, p, q) for n, p, q in zip(names, x, y) if p != q][:6]
        return f"{len(bad)} rows differ, first {x[:1]}: {diff}"
    return None


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_gaps(df, cursor) -> list[str]:
    """Columns whose type differs between the two engines."""
    want = {d[0]: str(d[1]) for d in cursor.description}
    return [f"{c}: {t} / {want[c]}" for c, t in df.dtypes if c in want and KINDS.get(t, t) != want[c]]


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from ledgerscope.session import local_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    names = [q for q in qs if not args.names or any(q.startswith(p) for p in args.names)]
    failed = []
    for q in names:
        t = time.time()
        try:
            df = qs[q](spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if q not in sqls:
                print(f"rows {q} n={len(got)} {took:.1f}s", flush=True)
                continue
            cur = con.execute(sqls[q])
            want_names = [d[0] for d in cur.description]
            gaps = type_gaps(df, cur)
            why = compare(got, df.columns, cur.fetchall(), want_names)
            if not why and gaps:
                why = f"types {gaps}"
        except Exception as e:  # noqa: BLE001
            took, why = time.time() - t, f"{type(e).__name__}: {str(e)[:1000]}"
        if why:
            failed.append(q)
        print(f"{'ok  ' if not why else 'FAIL'} {q} n={len(got) if not why else '-'} {took:.1f}s {why or ''}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} good; failed: {failed}")


if __name__ == "__main__":
    main()
