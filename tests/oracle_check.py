"""Run registered queries against their DuckDB twins, like the driver's gate.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE", "float": "FLOAT",
    "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def type_mismatches(sdf, res) -> list:
    duck = {d[0]: str(d[1]).upper() for d in res.description}
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        if duck.get(f.name) != want:
            out.append((f.name, f.dataType.simpleString(), duck.get(f.name)))
    return out


def compare(spark, name, fn, sql, con, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_s=round(t1 - t0, 2), note="rows-only")
    res = con.execute(sql)
    types = type_mismatches(sdf, res)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sc, sr = rows_of(scols, srows)
    dc, dr = rows_of(dcols, drows)
    info = dict(name=name, spark_rows=len(sr), duck_rows=len(dr), spark_s=round(t1 - t0, 2))
    if sc != dc:
        return dict(info, ok=False, note=f"columns {sc} vs {dc}")
    if len(sr) != len(dr):
        return dict(info, ok=False, note="row count")
    exact = sr == dr
    if exact and types:
        return dict(info, ok=False, note=f"types differ: {types}")
    if exact:
        return dict(info, ok=True)
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    return dict(info, ok=False, note=f"{len(bad)} rows differ; first: {bad[0]}")


def main(argv):
    from pyspark.sql import SparkSession

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E

    b = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false"))
    # Extra session settings, e.g. ORACLE_CONF="spark.sql.session.timeZone=America/New_York,spark.sql.adaptive.enabled=false"
    for kv in filter(None, os.environ.get("ORACLE_CONF", "").split(",")):
        k, v = kv.split("=", 1)
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, name, fn, ors.get(name), con, sf_dir)
        except Exception as ex:  # report and go on
            r = dict(name=name, ok=False, note=f"{type(ex).__name__}: {str(ex)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    extra = set(ors) - set(qs)
    if extra:
        print("oracle without query:", sorted(extra))
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
