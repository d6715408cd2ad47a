"""Runs a query's SQL in DuckDB over the same files and compares the rows."""

import glob
import os

import duckdb


def connect(sf):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def plain(rows, columns):
    """Rows in the order of column names; numbers that compare equal look equal."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        try:
            return round(float(x), 12) + 0.0 if x != int(x) or isinstance(x, float) else int(x)
        except (TypeError, ValueError, OverflowError):
            return str(x)

    return sorted([tuple(value(r[k]) for k in order) for r in rows], key=repr), sorted(columns)


def difference(df, sql, db):
    """None if the rows agree, else a short account."""
    found = db.sql(sql)
    want, names = plain(found.fetchall(), found.columns)
    got, columns = plain([tuple(r) for r in df.collect()], df.columns)
    if names != columns:
        return f"columns {columns}, not {names}"
    if got != want:
        return f"{len(got)} and {len(want)} rows; only here {[r for r in got if r not in set(want)][:3]}, only there {[r for r in want if r not in set(got)][:3]}"
    return None
