"""Run registered queries against their DuckDB oracles.

    python tests/compare.py sf0.01 [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark, con, build, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs first."""
    df = build(spark, sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(names, result.fetchall())
    if len(ours) != len(theirs):
        extra = [r for r in ours[:20000] if r not in set(theirs)][:2]
        lost = [r for r in theirs[:20000] if r not in set(ours)][:2]
        return f"rows {len(ours)} vs {len(theirs)}; only ours {extra}; only theirs {lost}"
    for a, b in zip(ours, theirs):
        if repr(a) != repr(b):
            return f"values {a} vs {b}"
    return None


if __name__ == "__main__":
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark, con = make_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or list(queries):
        if name not in oracles:
            print(f"{name:28s} no oracle", flush=True)
            continue
        start = time.time()
        try:
            found = difference(spark, con, queries[name], oracles[name], sf_dir)
        except Exception as exc:
            found = f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{name:28s} {'ok' if found is None else 'DIFF ' + found[:900]} {time.time() - start:.1f}s", flush=True)
