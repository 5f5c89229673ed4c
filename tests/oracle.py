"""Run registered queries next to their DuckDB text and compare the rows.

    python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(v) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(name, spark, con, sf_dir, queries, oracles):
    t = time.time()
    df = queries[name](spark, sf_dir)
    sc, sr = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if name not in oracles:
        return ("rows" if sr else "EMPTY"), len(sr), took, ""
    cur = con.execute(oracles[name])
    dc, dr = table([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return "COLS", len(sr), took, f"{sc} vs {dc}"
    if len(sr) != len(dr):
        return "COUNT", len(sr), took, f"{len(sr)} vs {len(dr)}"
    if sr != dr:
        ndiff, first = 0, ""
        bad = {}
        for a, b in zip(sr, dr):
            if a != b:
                ndiff += 1
                first = first or f"\n   spark {a}\n   duck  {b}"
                for c, x, y in zip(sc, a, b):
                    if x != y:
                        bad[c] = bad.get(c, 0) + 1
        return "DIFF", len(sr), took, f"{ndiff} rows, cols {bad} {first}"
    nulls = [c for i, c in enumerate(sc) if sr and all(r[i] is None for r in sr)]
    return ("ok" if sr else "EMPTY"), len(sr), took, (f"all-null {nulls}" if nulls else "")


def main(argv):
    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    import __spark_entry__ as entry
    from barlens.session import build_session
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = duck(sf)
    bad = 0
    for name in queries:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            st, n, took, msg = compare(name, spark, con, sf, queries, oracles)
        except Exception as ex:  # report and go on with the next query
            st, n, took, msg = "ERROR", 0, 0.0, str(ex)[:1500]
        bad += st not in ("ok", "rows")
        print(f"{st:6s} {name:40s} {n:7d} rows {took:6.1f}s {msg}", flush=True)
    print(f"not ok: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
