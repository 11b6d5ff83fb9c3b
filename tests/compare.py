"""Run registered queries and their SQL side by side: ``python tests/compare.py SF_DIR [names]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, (bool, int)):
        return str(int(value))
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return str(int(value)) if value.is_integer() else repr(value)
    return str(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    """Differences between one query and its SQL; empty when both agree."""
    df = query(spark, sf_dir)
    got_columns, got = table([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    want_columns, want = table(cursor.fetchall(), [c[0] for c in cursor.description])
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    if got == want:
        return [] if got else ["no rows on either side"]
    extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return [f"{len(got)} vs {len(want)} rows, {len(extra)} differ",
            *(f"  spark {r}" for r in extra[:3]), *(f"  sql   {r}" for r in missing[:3])]


def main() -> None:
    import __spark_entry__ as e
    from tallyscope.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connection(sf_dir)
    for name, query in e.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        sql = e.oracle_sql().get(name)
        if sql is None:
            result = f"rows {query(spark, sf_dir).count()}"
        else:
            found = compare(spark, con, sf_dir, query, sql)
            result = "ok" if not found else "DIFF " + "\n".join(found)
        print(f"{name:26s} {time.time() - start:6.1f}s {result}", flush=True)


if __name__ == "__main__":
    main()
