"""Compare a Spark result with the checking SQL: names, types, row counts and values."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
FAMILY = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def differences(df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    got_kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: {sorted(set(names) ^ set(df.columns))}"]
    for n in names:
        if FAMILY.get(kinds[n], kinds[n]) != got_kinds[n]:
            problems.append(f"type of {n}: {got_kinds[n]} here, {kinds[n]} there")
    order = sorted(names)
    at = {n: i for i, n in enumerate(names)}
    want = Counter(tuple(_plain(r[at[n]]) for n in order) for r in expected)
    have = Counter(tuple(_plain(r[n]) for n in order) for r in df.collect())
    if want != have:
        extra, lost = list((have - want).elements()), list((want - have).elements())
        problems.append(f"{sum(have.values())} rows here, {sum(want.values())} there, {len(extra)} only here")
        for side, rows in (("here", extra), ("there", lost)):
            for row in sorted(rows, key=str)[:2]:
                problems.append(f"only {side}: {dict(zip(order, row))}")
    return problems
