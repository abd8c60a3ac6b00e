"""Compare registered queries with their SQL counterparts: python tests/check_oracles.py SF_DIR [name ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from twinscan.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, folder, name):
    t0 = time.time()
    df = queries()[name](spark, folder)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"rows {len(ours)} (no SQL) {t1 - t0:.1f}s"
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    theirs = rows(columns, cur.fetchall())
    t2 = time.time()
    note = f"rows {len(ours)}/{len(theirs)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    if ours != theirs:
        extra, lost = [r for r in ours if r not in set(theirs)][:2], [r for r in theirs if r not in set(ours)][:2]
        return False, f"{note}\n   ours   {str(extra)[:700]}\n   theirs {str(lost)[:700]}"
    return True, note


if __name__ == "__main__":
    folder, wanted = sys.argv[1], sys.argv[2:] or list(queries())
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for n in wanted:
        try:
            ok, note = compare(spark, con, folder, n)
        except Exception as e:
            ok, note = False, str(e)[:900]
        bad += not ok
        print("ok  " if ok else "FAIL", n, note, flush=True)
    print("failed", bad)
