"""Queries over whole tables, at a size where a limit or an id subset would leave rows out."""

from collections import Counter

import duckdb
import pytest

import sluice.plans  # noqa: F401
from sluice.registry import ENTRIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("customer", "supplier", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_sort_nulls_returns_the_whole_table_in_order(spark, duck):
    got = [tuple(r) for r in ENTRIES["sort_nulls_whole"].run(spark, DATA).select("k", "v").collect()]
    assert got == duck.sql(ENTRIES["sort_nulls_whole"].sql).fetchall()
    assert len(got) == duck.sql("SELECT count(*) FROM customer").fetchall()[0][0] and got[-1][1] is None


@pytest.mark.parametrize("name", ["union_by_name_whole", "join_lateral_whole"])
def test_whole_tables_equal_sql(spark, duck, name):
    want = duck.sql(ENTRIES[name].sql)
    got = ENTRIES[name].run(spark, DATA).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


def test_no_customer_is_left_out(spark, duck):
    count = lambda sql: duck.sql(sql).fetchall()[0][0]
    assert ENTRIES["union_by_name_whole"].run(spark, DATA).count() == count("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")
    lateral = ENTRIES["join_lateral_whole"].run(spark, DATA).select("c_custkey").distinct().count()
    assert lateral == count("SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey")


def test_both_names_give_the_whole(spark):
    for name in ("sort_nulls", "union_by_name", "join_lateral"):
        assert ENTRIES[name].run is ENTRIES[f"{name}_whole"].run and ENTRIES[name].sql == ENTRIES[f"{name}_whole"].sql
