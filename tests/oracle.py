"""Compare registered queries with their SQL: ``python tests/oracle.py SF [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as driver  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return value


def difference(spark, db, sf_dir: str, name: str) -> str:
    """Empty when both engines agree on columns and rows, else what differs."""
    left = driver.queries()[name](spark, sf_dir)
    columns = sorted(left.columns)
    mine = Counter(tuple(_plain(v) for v in r) for r in left.select(*columns).collect())
    result = db.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
    if not mine:
        return "no rows"
    if mine == theirs:
        return ""
    only, missing = mine - theirs, theirs - mine
    return (
        f"{sum(mine.values())} and {sum(theirs.values())} rows; "
        f"only Spark: {str(list(only)[:2])[:300]}; only SQL: {str(list(missing)[:2])[:300]}"
    )


if __name__ == "__main__":
    from broadsheet.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = build_session("local[8]", 8)
    db = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or driver.queries():
        start = time.time()
        try:
            found = difference(spark, db, sf_dir, name)
        except Exception as error:  # keep going: report every query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {name} {time.time() - start:.1f}s {found}", flush=True)
    print("bad:", bad, "of", len(sys.argv[2:] or driver.queries()))
