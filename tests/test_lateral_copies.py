"""Rows on which the lateral query and its SQL could part: keys that repeat, equal prices and null keys."""

from collections import Counter

import duckdb
import pytest

import sluice.plans  # noqa: F401
from sluice.registry import ENTRIES


@pytest.mark.parametrize("name", ["join_lateral", "join_lateral_whole"])
def test_lateral_of_repeated_customers_equals_sql(spark, tmp_path, name):
    """Keys held by one, two and three customers, equal prices, and a null order key among them."""
    customers = [(1,), (2,), (2,), (3,), (3,), (3,), (4,)]
    orders = [(10, 1, 5.0), (11, 1, 5.0), (12, 1, 9.0), (20, 2, 1.0), (21, 2, 7.0), (30, 3, 2.0), (31, 3, 2.0), (None, 1, 9.0), (40, 5, 1.0)]
    spark.createDataFrame(customers, "c_custkey long").write.parquet(f"file://{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"file://{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = ENTRIES[name].run(spark, f"file://{tmp_path}").select("c_custkey", "o_orderkey").collect()
    assert Counter(map(tuple, got)) == Counter(con.sql(ENTRIES[name].sql).fetchall())
