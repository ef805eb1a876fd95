"""Compare registered queries with their DuckDB text: ``python tests/oracle.py FOLDER [NAME...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def canonical(columns, rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    df = query(spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = canonical(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return True, f"{len(got)} rows"
    a, b = {repr(r) for r in got}, {repr(r) for r in want}
    return False, f"{len(got)} vs {len(want)}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


def session():
    from stayweave.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(folder)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, folder, name, query, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.time() - start:6.2f}s {note}", flush=True)
