"""Holds queries against their SQL: python -m tests.compare SF_DIR [NAME...]."""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if hasattr(value, "normalize"):
        return plain(float(value))
    return str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


def same(spark, db, sf, query, sql):
    df = query(spark, sf)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = db.execute(sql)
    return mine, rows([d[0] for d in theirs.description], theirs.fetchall())


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from loomgraph.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, db = local_session(4), database(sf)
    spark.sparkContext.setLogLevel("OFF")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in names or sqls:
        began = time.time()
        try:
            a, b = same(spark, db, sf, queries[name], sqls[name])
            extra = "" if a == b else f" columns {a[0]} {b[0]} rows {len(a[1])} {len(b[1])} first {next((x for x in zip(a[1], b[1]) if x[0] != x[1]), '')}"
            print(name, "ok" if a == b else "DIFFERS", len(a[1]), f"{time.time() - began:.1f} s", extra[:700], flush=True)
        except Exception as e:
            print(name, "FAILED", str(e)[:600].replace("\n", " "), flush=True)
