"""Queries over many keys: work goes by batches and groups of many keys, and no value of a column is one task."""

import glob
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import sluice.plans  # noqa: F401
from sluice.registry import ENTRIES
from sluice.sources.tables import partitioned


def test_each_task_writes_its_own_part_of_a_value(spark):
    """Rows of one value in six tasks stay in six: none is sent to one task."""
    rows = spark.range(0, 6000, 1, 6).select("id", F.lit("R").alias("flag"))
    out = partitioned(rows, "flag")
    assert out.where("flag = 'R'").count() == 6000
    path = out.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert path.endswith("flag=R") and len(glob.glob(f"/{path.lstrip('/')}/*.parquet")) == 6


@pytest.fixture
def batches_of_three(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_two_highest_over_small_batches(spark, tmp_path, batches_of_three):
    """Keys go on over batches; repeated and null prices, one null key."""
    rng = random.Random(17)
    rows = [(rng.choice([*range(15), None]), rng.choice([1.0, 2.0, 3.5, 4.0, None])) for _ in range(300)] + [(99, None), (98, 1.0)]
    spark.createDataFrame(rows, "l_partkey long, l_extendedprice double").repartition(4).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    prices = defaultdict(set)
    for k, p in rows:
        prices[k] |= {p} - {None}
    want = {k: (*sorted(p, reverse=True)[:2], None, None)[:2] for k, p in prices.items()}
    got = [(r.l_partkey, (r.highest, r.second)) for r in ENTRIES["udaf_two_phase"].run(spark, f"file://{tmp_path}").collect()]
    assert dict(got) == want and len(got) == len(want)


def test_no_python_group_for_each_key(spark):
    """What runs in Python is dealt by batch or by group of many keys, not by the key itself."""
    plan = {n: ENTRIES[n].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString() for n in ("udaf_two_phase", "cogroup_in_pandas")}
    assert "FlatMapGroups" not in plan["udaf_two_phase"]
    assert "xxhash64(user_id" in plan["cogroup_in_pandas"] and "xxhash64(o_custkey" in plan["cogroup_in_pandas"]


def test_cogroup_of_missing_and_repeated_customers_equals_sql(spark, tmp_path):
    tables = {
        "customer": ([(1,), (2,), (2,), (3,), (4,), (5,)], "c_custkey long"),
        "events": ([(1, 2.0), (1, None), (2, None), (3, 1.0), (None, 5.0), (9, 1.0)], "user_id long, value double"),
        "orders": ([(1, 2000.0), (1, 2000.5), (2, 9.0), (4, 7.0), (None, 1.0)], "o_custkey long, o_totalprice double"),
    }
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = ENTRIES["cogroup_in_pandas"].run(spark, f"file://{tmp_path}").select("c_custkey", "events", "orders", "large").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ENTRIES["cogroup_in_pandas"].sql).fetchall())
