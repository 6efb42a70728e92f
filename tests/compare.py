"""Side-by-side run of a registered query and its SQL counterpart."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    return str(value.replace(tzinfo=None)) if hasattr(value, "tzinfo") else str(value)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return _table(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    return _table([d[0] for d in result.description], result.fetchall())


def difference(left, right):
    """None if equal, else a short description."""
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if left[1] == right[1]:
        return None
    only_left = sorted(set(left[1]) - set(right[1]))[:3]
    only_right = sorted(set(right[1]) - set(left[1]))[:3]
    return f"rows {len(left[1])} / {len(right[1])}\n  spark {only_left}\n  duck  {only_right}"
