"""Run a query on Spark and its SQL on DuckDB and compare columns, types and rows."""

from __future__ import annotations

import math
import time
from collections import Counter
from pathlib import Path

import duckdb

SAME = {"long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    return None if isinstance(x, float) and math.isnan(x) else x


def compare(spark, con, sf_dir, run, sql):
    """(problem or None, seconds on Spark, seconds on DuckDB, rows)."""
    t0 = time.time()
    df = run(spark, sf_dir)
    got_types = dict(df.dtypes)
    names = sorted(df.columns)
    rows = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return None, t1 - t0, 0.0, len(rows)
    cur = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in cur.description}
    order = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    problem = None
    if sorted(want_types) != names:
        problem = f"columns {names} != {sorted(want_types)}"
    else:
        wrong = {n: (got_types[n], want_types[n]) for n in names if SAME.get(got_types[n], got_types[n]) != want_types[n]}
        at = [order.index(n) for n in names]
        expected = [tuple(_cell(r[i]) for i in at) for r in want]
        if wrong:
            problem = f"types {wrong}"
        elif Counter(rows) != Counter(expected):
            extra, lack = Counter(rows) - Counter(expected), Counter(expected) - Counter(rows)
            problem = f"{len(rows)} rows vs {len(expected)}; {sum(extra.values())} differ\n   spark {list(extra)[:2]}\n   sql   {list(lack)[:2]}"[:1500]
    return problem, t1 - t0, t2 - t1, len(rows)
