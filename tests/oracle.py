"""Compare a query with its SQL twin in DuckDB: rows, columns and values, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _plain(x)) for k, x in v.asDict().items()))
    return v


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, sf_dir)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    rel = sorted(names)
    at = [names.index(n) for n in rel]
    want = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    got = [tuple(_plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in rel]).collect()]
    from collections import Counter

    a, b = Counter(got), Counter(want)
    if a == b:
        return ""
    more, less = list((a - b).elements()), list((b - a).elements())
    return f"rows {len(got)} and {len(want)}; only here {len(more)}: {more[:5]}; only SQL {len(less)}: {less[:5]}"
