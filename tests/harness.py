"""Run registered queries on Spark and their SQL twins on DuckDB, and compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from hazardlake.plans.fixtures import TABLES  # noqa: E402


def session(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def duck_rows(con, sql: str):
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    return [cols[i] for i in order], rows


def main(argv):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    for a in argv:
        if a.startswith("/"):
            sf = a
    spark, con = session(), duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if names and not any(n in name for n in names):
            continue
        t0 = time.time()
        try:
            cols, rows = spark_rows(fn(spark, sf))
            t1 = time.time()
            note = f"rows={len(rows)} spark={t1 - t0:.2f}s"
            if name in sqls:
                dcols, drows = duck_rows(con, sqls[name])
                note += f" duck={time.time() - t1:.2f}s"
                if cols != dcols:
                    bad.append(name)
                    note += f" COLUMNS {cols} vs {dcols}"
                elif rows != drows:
                    bad.append(name)
                    diff = [(a, b) for a, b in zip(rows, drows) if a != b][:2]
                    note += f" DIFF spark={len(rows)} duck={len(drows)} {str(diff)[:900]}"
                elif not rows:
                    note += " EMPTY"
                else:
                    note += " ok"
            else:
                note += " (no sql)" + ("" if rows else " EMPTY")
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            note = f"ERROR {type(e).__name__} {str(e)[:700]}"
        print(f"{name}: {note}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
