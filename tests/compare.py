"""Run registered queries against their check SQL.

    python tests/compare.py [scale] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value) if not isinstance(value, bool) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None if equal, else what differs."""
    got_cols, got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} / {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}; e.g. {got[:2]} / {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"values {g} / {w} ({sum(a != b for a, b in zip(got, want))} rows)"
    return None


def main(scale="0.01", *names):
    import __spark_entry__ as entry
    from tidemark.session import local_session

    folder = f"/root/testdata/sf{scale}"
    spark = local_session(8)
    con = connect(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in checks:
                mid = time.time()
                fault = compare(df, con, checks[name])
            else:
                fault, n = None, df.count()
                print(f"rows  {name} {n}")
        except Exception as exc:  # a report must go on
            fault = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += fault is not None
        print(f"{'FAIL' if fault else 'ok  '}  {name}  {time.time() - start:.1f}s"
              + (f"  {fault}" if fault else ""), flush=True)
    print("failures:", bad, "of", len(names or queries))


if __name__ == "__main__":
    main(*sys.argv[1:])
