"""Every operator with SQL gives DuckDB's rows; every other one runs."""

from __future__ import annotations

import duckdb
import pytest

import tidemark.catalogue  # noqa: F401
from tidemark import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows), [columns[i] for i in order]


@pytest.mark.parametrize("key", sorted(registry.OPERATORS))
def test_operator(key, spark, sf, duck):
    df = registry.queries()[key](spark, sf)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if key not in registry.SQL:
        assert got[1]
        return
    r = duck.execute(registry.SQL[key])
    columns = [x[0] for x in r.description]
    want = canonical(r.fetchall(), columns)
    assert got[1] == want[1]
    assert got[0] == want[0]
    kinds = {x[0]: str(x[1]) for x in r.description}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds


def test_every_identifier_of_the_inventory_is_there():
    counts = {"src": 12, "snk": 8, "flt": 13, "prj": 8, "jn": 17, "agg": 22, "win": 15, "ord": 15, "set": 4, "sc": 25, "sch": 14, "cmd": 37, "wf": 15, "st": 16, "udf": 6, "api": 4}
    missing = [f"{k}_{i:02d}" for k, n in counts.items() for i in range(1, n + 1) if f"{k}_{i:02d}" not in registry.OPERATORS]
    assert not missing
