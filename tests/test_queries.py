"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import sluice.plans  # noqa: F401
from sluice.registry import ENTRIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v if isinstance(v, (bool, int, str, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_equals_sql(spark, duck, name):
    entry = ENTRIES[name]
    df = entry.run(spark, DATA)
    got = df.collect()
    want = duck.sql(entry.sql)
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(plain(r[c]) for c in cols) for r in got) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if not e.sql))
def test_runs(spark, name):
    assert ENTRIES[name].run(spark, DATA).count() > 0
