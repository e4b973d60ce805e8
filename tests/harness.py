"""Runs registered queries beside their SQL and compares the rows, whatever their order."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb


def oracle_connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if hasattr(value, "is_integer") or value.__class__.__name__ == "Decimal":
        return round(float(value), 5) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(name, df, con, sql):
    got = df.collect()
    got_names = df.columns
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} against {sorted(want_names)}", len(got)
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a != b:
        sa, sb = set(a), set(b)
        onlya = [r for r in a if r not in sb][:3]
        onlyb = [r for r in b if r not in sa][:3]
        return f"{len(a)} rows against {len(b)}; only ours {onlya}; only SQL's {onlyb}", len(got)
    return None, len(got)


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from wickerwork.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                wrong, n = compare(name, df, con, oracle[name])
            else:
                wrong, n = None, len(df.collect())
        except Exception as e:  # noqa: BLE001
            wrong, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        kind = "sql" if name in oracle else "rows"
        flag = "ok" if wrong is None and n > 0 else "EMPTY" if wrong is None else "BAD"
        bad += flag != "ok"
        print(f"{flag:5} {kind:4} {time.time() - start:6.2f}s {n:7d} {name} {wrong or ''}", flush=True)
    print(f"{len(chosen)} queries, {bad} not ok", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
