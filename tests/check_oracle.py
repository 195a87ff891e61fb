"""Compare registered queries with their SQL: python tests/check_oracle.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(value):
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def _key(row):
    return tuple((value is None, type(value).__name__, value if value is not None else 0) for value in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_kind(row[i]) for i in order) for row in rows), key=_key)


FAMILY = {"HUGEINT": "hugeint", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
          "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}


def compare(spark, con, sf_dir, entry):
    frame = entry.run(spark, sf_dir)
    spark_rows = rows_of(frame.columns, frame.collect())
    result = con.sql(entry.sql)
    duck_rows = rows_of(result.columns, result.fetchall())
    problems = []
    if sorted(frame.columns) != sorted(result.columns):
        return [f"columns {sorted(frame.columns)} / {sorted(result.columns)}"], len(spark_rows)
    kinds = dict(frame.dtypes)
    for name, dtype in zip(result.columns, result.types):
        family = FAMILY.get(str(dtype), str(dtype))
        if family != kinds[name]:
            problems.append(f"type of {name}: {kinds[name]} / {family}")
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} / {len(duck_rows)}")
    differing = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if differing:
        problems.append(f"{len(differing)} rows differ, columns {sorted(frame.columns)}: {differing[0]}")
    return problems, len(spark_rows)


def main():
    from pyspark.sql import SparkSession

    from visitledger.checks import CHECKS

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for name, entry in CHECKS.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            if entry.sql is None:
                n = entry.run(spark, sf_dir).count()
                print(f"rows {name} {n} {time.time() - began:.1f}s", flush=True)
                continue
            problems, n = compare(spark, con, sf_dir, entry)
        except Exception as error:
            problems, n = [str(error)[:1500]], -1
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name} {n} {time.time() - began:.1f}s", *problems, sep="\n     ", flush=True)
    print(f"{bad} bad", flush=True)


if __name__ == "__main__":
    main()
