"""Run registered queries against their check SQL in DuckDB and compare all values."""

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """Null when both sides hold the same rows, else what differs."""
    spark_rows = _rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)}, sql {sorted(names)}"
    sql_rows = _rows(names, result.fetchall())
    if spark_rows == sql_rows:
        return None
    return (f"rows: spark {sum(spark_rows.values())}, sql {sum(sql_rows.values())}\n"
            f"  only spark: {list((spark_rows - sql_rows).items())[:3]}\n  only sql:   {list((sql_rows - spark_rows).items())[:3]}")


def main(sf_dir: str, names: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from idsignal.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            wrong = difference(df, con, oracles[name]) if name in oracles else f"no SQL, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            wrong = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += wrong is not None
        print(f"{'ok  ' if wrong is None else 'DIFF'} {name} {time.time() - start:.1f}s {wrong or ''}", flush=True)
    print(f"{failed} not equal")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
