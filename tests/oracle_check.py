"""Runs registered queries next to their SQL in DuckDB and compares rows; usage: oracle_check.py SF_DIR [names]."""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return None if math.isnan(f) else round(f, 6) + 0.0
    return str(v)


def compare(spark_rows, spark_cols, sql_rows, sql_cols) -> str | None:
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns {sorted(spark_cols)} != {sorted(sql_cols)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    cols = sorted(spark_cols)
    a = [spark_cols.index(c) for c in cols]
    b = [sql_cols.index(c) for c in cols]
    left = sorted((tuple(canon(r[i]) for i in a) for r in spark_rows), key=repr)
    right = sorted((tuple(canon(r[i]) for i in b) for r in sql_rows), key=repr)
    for x, y in zip(left, right):
        if x != y:
            return "first difference:\n   spark " + repr(dict(zip(cols, x)))[:900] + "\n   sql   " + repr(dict(zip(cols, y)))[:900]
    return None


def check(spark, con, sf: str, name: str, queries, oracles) -> tuple[bool, str]:
    t0 = time.time()
    df = queries[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in oracles:
        return True, f"{len(rows)} rows, no SQL, {t1 - t0:.1f}s"
    cur = con.execute(oracles[name])
    cols = [d[0] for d in cur.description]
    problem = compare(rows, df.columns, cur.fetchall(), cols)
    nested = [f.dataType.simpleString() for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    note = f" NESTED {nested}" if nested else ""
    return problem is None, (problem or f"{len(rows)} rows") + note + f", spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s"


def main() -> int:
    import __spark_entry__ as entry
    from quorumtext.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = local_session(), connect(sf)
    bad = []
    for name in names or sorted(queries):
        try:
            ok, text = check(spark, con, sf, name, queries, oracles)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, text = False, f"{type(e).__name__}: {str(e)[:1200]}"
        if not ok:
            bad.append(name)
        print(("ok   " if ok else "FAIL ") + name + ": " + text, flush=True)
    print(f"{len(bad)} failed: {bad}")
    spark.stop()
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
