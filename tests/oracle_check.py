"""Run catalogue queries in Spark and their oracle SQL in DuckDB, and compare all rows.

``python tests/oracle_check.py [folder] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def normal(value):
    if value is None or isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def oracle_rows(folder: str, sql: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    return rows_of(columns, cursor.fetchall())


def compare(spark, folder: str, query, sql: str | None) -> str:
    df = query(spark, folder)
    got_columns, got = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows only: {len(got)}"
    columns, want = oracle_rows(folder, sql)
    if columns != got_columns:
        return f"COLUMNS DIFFER {got_columns} {columns}"
    if got != want:
        only_got = sorted(set(got) - set(want))[:2]
        only_want = sorted(set(want) - set(got))[:2]
        return f"ROWS DIFFER {len(got)} {len(want)} got {only_got} want {only_want}"[:1500]
    return f"same: {len(got)} rows"


def main() -> int:
    import importlib

    from tests.session import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = set(sys.argv[2:])
    areas = [a for a in ("records", "retrieval", "answers", "reports", "streams")]
    spark, bad = session(), 0
    for area in areas:
        try:
            module = importlib.import_module(f"termloom.catalog.{area}")
        except ModuleNotFoundError:
            continue
        for name, query in module.QUERIES.items():
            if names and name not in names and area not in names:
                continue
            started = time.perf_counter()
            try:
                result = compare(spark, folder, query, module.ORACLES.get(name))
            except Exception as error:
                result = f"ERROR {type(error).__name__}: {str(error)[:900]}"
            bad += not result.startswith(("same", "rows only"))
            print(f"{name}: {result} ({time.perf_counter() - started:.1f}s)", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
