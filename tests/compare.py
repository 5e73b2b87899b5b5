"""Run registered queries and their SQL side by side.

    python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark_df, con, sql: str) -> str | None:
    """None when rows, column names, types and values agree."""
    bad = type_difference(spark_df, con, sql)
    if bad:
        return bad
    columns = ", ".join(f'"{c}"' for c in sorted(spark_df.columns))
    con.register("got", spark_df.toArrow())
    con.execute(f"CREATE OR REPLACE TEMP TABLE want AS SELECT {columns} FROM ({sql})")
    n = con.execute("SELECT (SELECT count(*) FROM got), (SELECT count(*) FROM want)").fetchone()
    if n[0] != n[1]:
        return f"rows {n[0]} != {n[1]}"
    extra = con.execute(f"SELECT {columns} FROM got EXCEPT ALL SELECT {columns} FROM want LIMIT 1").fetchall()
    missing = con.execute(f"SELECT {columns} FROM want EXCEPT ALL SELECT {columns} FROM got LIMIT 1").fetchall()
    return f"{columns}: {extra} != {missing}" if extra or missing else None


def type_difference(spark_df, con, sql: str) -> str | None:
    names = {"VARCHAR": "string", "INTEGER": "int", "TIMESTAMP": "timestamp_ntz"}
    types = {row[0]: names.get(row[1], row[1].lower()) for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(types) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(types)}"
    bad = [f"{f.name}: {f.dataType.simpleString()} != {types[f.name]}" for f in spark_df.schema.fields
           if f.dataType.simpleString() != types[f.name]]
    return f"types {bad}" if bad else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                found = difference(df, con, oracles[name])
            else:
                found = None if df.count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name:26s} {time.time() - t:6.1f}s "
              f"{'' if name in oracles else '(no SQL)'} {found or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
