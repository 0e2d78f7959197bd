"""Run registered queries against their SQL on one folder and compare all rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return x


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, function, sql: str | None) -> tuple[bool, str]:
    began = time.time()
    frame = function(spark, folder)
    got = frame.collect()
    spent = time.time() - began
    if sql is None:
        return True, f"rows-only {len(got)} ({spent:.1f}s)"
    began = time.time()
    answer = con.execute(sql)
    wanted_names = [d[0] for d in answer.description]
    wanted = answer.fetchall()
    other = time.time() - began
    if sorted(wanted_names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(wanted_names)}"
    a, b = rows_of(frame.columns, got), rows_of(wanted_names, wanted)
    text = f"{len(got)} vs {len(wanted)} rows ({spent:.1f}s, {other:.1f}s)"
    if a == b:
        return True, text
    return False, (f"{text}\n   columns {sorted(frame.columns)}\n   only here "
                   f"{list((a - b).items())[:3]}\n   only sql {list((b - a).items())[:3]}")


def main() -> None:
    import __spark_entry__ as entry
    from cliploom.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(os.environ.get("COMPARE_CPUS", "8"))
    con = connect(folder)
    sqls, bad = entry.oracle_sql(), []
    for name, function in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, folder, name, function, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{type(error).__name__}: {str(error)[:900]}"
        print(("ok  " if ok else "BAD ") + name, text, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
