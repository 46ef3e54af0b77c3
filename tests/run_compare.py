"""python -m tests.run_compare [sf] [name ...]: print one line per query."""

import sys

import __spark_entry__ as entry
from hiresift.session import build_session
from tests.compare import compare, connect


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            problem, a, b, n = compare(spark, con, sf_dir, run, sqls.get(name))
        except Exception as error:
            problem, a, b, n = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0, 0
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} spark={a:.2f}s sql={b:.2f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
