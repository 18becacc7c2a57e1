"""Result comparison used by tests and tools: Spark DataFrame vs DuckDB SQL on the same parquet tables.

Mirrors the correctness gate: same row count, same column names and types, same multiset of
rows after sorting columns by name (doubles rounded to ``digits``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wavekit.sources.tables import TABLES

SPARK_TO_DUCK = {
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.DoubleType: "DOUBLE",
    T.FloatType: "FLOAT",
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.ShortType: "SMALLINT",
    T.ByteType: "TINYINT",
    T.DateType: "DATE",
}


def duck_connect(data_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir.rstrip('/')}/{t}.parquet')")
    return con


def spark_types(df: DataFrame) -> dict[str, str]:
    out = {}
    for f in df.schema.fields:
        out[f.name] = SPARK_TO_DUCK.get(type(f.dataType), f.dataType.simpleString().upper())
    return out


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in row)


def compare(sdf: DataFrame, con, sql: str, digits: int = 6) -> tuple[bool, str]:
    rel = con.sql(sql)
    dcols = list(rel.columns)
    dtypes = [str(t) for t in rel.types]
    stypes = spark_types(sdf)
    scols = list(sdf.columns)
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}"
    dmap = dict(zip(dcols, dtypes))
    bad = {c: (stypes[c], dmap[c]) for c in scols if stypes[c] != dmap[c]}
    if bad:
        return False, f"types differ: {bad}"
    order = sorted(scols)
    srows = [tuple(_norm(r[c], digits) for c in order) for r in sdf.select(*order).collect()]
    drows = [tuple(_norm(v, digits) for v in r) for r in rel.select(*[f'"{c}"' for c in order]).fetchall()]
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}"
    srows.sort(key=_key)
    drows.sort(key=_key)
    diffs = [(a, b) for a, b in zip(srows, drows) if a != b]
    if diffs:
        return False, f"{len(diffs)} rows differ, first: spark={diffs[0][0]} duck={diffs[0][1]}"
    return True, f"{len(srows)} rows"
