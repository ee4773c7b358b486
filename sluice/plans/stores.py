"""Tables of the catalogue, a data source and writer of our own, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.registry import query
from sluice.sources import segments, tables
from sluice.sources.tables import load
from sluice.streaming import bounded


@query("source_catalog", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def source_catalog(spark, sf_dir):
    """A table created, appended to and read by name."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return tables.catalogue_table(s, c)


def _deliveries(spark, sf_dir):
    """The events in three deliveries by time, as they would be committed one after another."""
    rows = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    edges = [low + (high - low) * i / 3 for i in (1, 2)] if low else []
    if not edges:
        return [rows]
    return [rows.where(F.col("ts") < edges[0]), rows.where((F.col("ts") >= edges[0]) & (F.col("ts") < edges[1])), rows.where(F.col("ts") >= edges[1])]


@query("source_python", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE value >= 10")
def source_python(spark, sf_dir):
    """A table of committed segments, read by a Python data source in Arrow batches, a segment a task."""
    root = bounded.new_root(spark)
    for part in _deliveries(spark, sf_dir):
        segments.append(part, f"{root}/log")
    return segments.read(spark, f"{root}/log").where("value >= 10")


@query("stream_python_source", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2")
def stream_python_source(spark, sf_dir):
    """The segments as a stream that is stopped and started again after each commit: every row is read once."""
    root = bounded.new_root(spark)
    for part in _deliveries(spark, sf_dir):
        segments.append(part, f"{root}/log")
        read = bounded.run(segments.stream(spark, f"{root}/log"), "append", root)
    return read.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("sink_commit", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_custkey, 'done', o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'P'")
def sink_commit(spark, sf_dir):
    """A writer with commit: a first version, one that replaces it, and one that adds to that."""
    path = f"{bounded.new_root(spark)}/table"
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    segments.append(orders, path)
    segments.append(orders.where("o_orderstatus <> 'P'"), path, overwrite=True)
    segments.append(orders.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("done")), path)
    return segments.read(spark, path)


@query("upsert", """SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN c_acctbal ELSE top END AS balance FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey
UNION ALL SELECT -s_suppkey, s_acctbal FROM supplier""")
def upsert(spark, sf_dir):
    """Balances, changed where there are finished orders, and new keys added."""
    old = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    changed = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("balance"))
    added = load(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("balance"))
    return tables.upsert(old, changed.unionByName(added), "c_custkey")
