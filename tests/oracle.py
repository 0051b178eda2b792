"""Holds a Spark result against the same query's SQL in DuckDB."""

import os

import duckdb


def views(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def same(spark_df, sql, sf_dir):
    got = rows(spark_df.columns, spark_df.collect())
    cursor = views(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(spark_df.columns)
    assert got == rows(names, cursor.fetchall())
