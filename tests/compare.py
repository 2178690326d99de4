"""Comparing a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    # pandas has floats for whole numbers where some are null
    frame = frame[columns].convert_dtypes(convert_string=False, convert_boolean=False).astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    a, b = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))
