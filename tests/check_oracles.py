"""Run queries next to their SQL in DuckDB: python tests/check_oracles.py [folder] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from flowspark.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅" if value is None else "nan"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def kind(values) -> str:
    kinds = {type(v).__name__ for v in values if v is not None}
    return "/".join(sorted(kinds))


def compare(spark, con, folder: str, name: str) -> tuple[str, int, str]:
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    rows = df.collect()
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows", len(got), ""
    result = con.sql(sql)
    names = list(result.columns)
    if sorted(names) != columns:
        return "COLUMNS", len(got), f"{columns} vs {sorted(names)}"
    order = [names.index(c) for c in columns]
    fetched = result.fetchall()
    want = sorted(tuple(plain(row[i]) for i in order) for row in fetched)
    if got == want:
        types = [(c, kind(r[c] for r in rows), kind(row[i] for row in fetched)) for c, i in zip(columns, order)]
        other = [t for t in types if t[1] != t[2]]
        return ("TYPES" if other else "ok"), len(got), str(other) if other else ""
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    return "DIFF", len(got), f"{len(got)} vs {len(want)} rows\n   spark {only_got}\n   sql   {only_want}"


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.001"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in args[1:] or list(entry.queries()):
        started = time.time()
        try:
            status, rows, detail = compare(spark, con, folder, name)
        except Exception as problem:  # noqa: BLE001
            status, rows, detail = "ERROR", 0, f"{type(problem).__name__}: {str(problem)[:600]}"
        bad += status not in ("ok", "rows")
        print(f"{status:8} {name:28} {rows:7} {time.time() - started:6.1f}s {detail}", flush=True)
    print(f"{bad} bad")
