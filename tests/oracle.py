"""A query's rows against DuckDB's rows of its SQL."""

import math

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (bytearray, memoryview)):
        return bytes(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, sql, con):
    """None, or what differs."""
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = rows(columns, found.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {df.columns} and {columns}"
    got = rows(df.columns, df.collect())
    if got == want:
        return None
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}; first only here {next((x for x in got if x not in want[:5000]), None)!r:.300}"
    a, b = next((a, b) for a, b in zip(got, want, strict=True) if a != b)
    return f"{a!r:.300} and {b!r:.300}"
