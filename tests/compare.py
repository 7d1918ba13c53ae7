"""Run queries on Spark and DuckDB and compare rows, column names and value kinds."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, type(v).__name__, v) for v in row)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def differences(df, con, sql, show: int = 3) -> str | None:
    mine, theirs = spark_rows(df), duck_rows(con, sql)
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if mine[1] == theirs[1]:
        return None
    pairs = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b][:show]
    return f"{len(mine[1])} rows against {len(theirs[1])}; {[str(p)[:1200] for p in pairs]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), oracle_sql(), []
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            result = differences(query(spark, sf_dir), con, sqls[name]) if name in sqls else f"no oracle, {query(spark, sf_dir).count()} rows"
        except Exception as exc:
            result = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {'equal' if result is None else result}", flush=True)
        if result is not None:
            bad.append(name)
    print(len(bad), "not equal:", *bad)
