"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle.py [sf dir] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT:
        return "\\N"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def canonical(pdf: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(pdf.columns)
    pdf = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return sorted(tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def differences(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} != {sorted(expected.columns)}"
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    left, right = canonical(actual), canonical(expected)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        only = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
        return f"{len(wrong)} rows differ in {sorted(actual.columns)}, e.g. {only}"
    kinds = [
        (c, str(actual[c].dtype), str(expected[c].dtype)) for c in sorted(actual.columns)
        if len(actual) and actual[c].dtype.kind != expected[c].dtype.kind and not (
            {actual[c].dtype.kind, expected[c].dtype.kind} <= set("iu"))
        and not ({actual[c].dtype.kind, expected[c].dtype.kind} <= set("OT") or "str" in str(expected[c].dtype))
    ]
    return f"kinds {kinds}" if kinds else None


def main(sf_dir: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from filinglens.session import local_session

    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            start = time.time()
            actual = fn(spark, sf_dir).toPandas()
            spent = time.time() - start
            verdict, lap = None, 0.0
            if name in oracles:
                start = time.time()
                expected = con.execute(oracles[name]).df()
                lap = time.time() - start
                verdict = differences(actual, expected)
            mark = "ok  " if not verdict else "FAIL"
            note = "" if name in oracles else " (rows only)"
            print(f"{mark} {name:42s} rows={len(actual):7d} spark={spent:6.2f}s sql={lap:6.2f}s{note} {verdict or ''}",
                  flush=True)
            failed += bool(verdict)
        except Exception as error:  # noqa: BLE001
            failed += 1
            text = "".join(traceback.format_exception_only(error)).strip()
            print(f"ERR  {name}: {text[:700]}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, args) else 0)
