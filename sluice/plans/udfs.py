"""Extension points: scalar, vectorised, grouped and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sluice.registry import query
from sluice.sources.tables import load


@query("udf_pandas", "SELECT p_partkey, p_retailprice * 2 + p_size AS x FROM part")
def udf_pandas(spark, sf_dir):
    @F.pandas_udf("double")
    def twice(a: pd.Series, b: pd.Series) -> pd.Series:
        return a * 2 + b

    return load(spark, sf_dir, "part").select("p_partkey", twice("p_retailprice", "p_size").alias("x"))


@query("udf_arrow", "SELECT p_partkey, upper(p_name) AS name FROM part")
def udf_arrow(spark, sf_dir):
    @F.arrow_udf("string")
    def upper(a: pa.Array) -> pa.Array:
        return pc.utf8_upper(a)

    return load(spark, sf_dir, "part").select("p_partkey", upper("p_name").alias("name"))


@query("udf_row", "SELECT n_nationkey, length(n_name) % 3 AS k FROM nation")
def udf_row(spark, sf_dir):
    """A row-at-a-time function, on a table that is fixed at 25 rows."""
    return load(spark, sf_dir, "nation").select("n_nationkey", F.udf(lambda s: len(s) % 3, "long")("n_name").alias("k"))


@query("udaf_grouped", "SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS mean FROM part GROUP BY 1")
def udaf_grouped(spark, sf_dir):
    """A weighted mean: an aggregate composed of two sums, which combine before the shuffle."""
    a = F.sum(F.col("p_retailprice") * F.col("p_size")) / F.sum("p_size")
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(a, 6).alias("mean"))


@query("udaf_pandas", "SELECT n_regionkey, CAST(max(length(n_name)) AS BIGINT) AS longest FROM nation GROUP BY 1")
def udaf_pandas(spark, sf_dir):
    @F.pandas_udf("long")
    def longest(s: pd.Series) -> int:
        return int(s.str.len().max())

    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(longest("n_name").alias("longest"))


@query("udtf", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf(spark, sf_dir):
    """A table function, joined laterally."""

    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for w in text.split(" "):
                yield (w,)

    spark.udtf.register("words_of", Words)
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, word FROM part, LATERAL words_of(p_name)")


@query("apply_in_pandas", "SELECT r_regionkey AS k, CAST(count(*) AS BIGINT) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def apply_in_pandas(spark, sf_dir):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["n_regionkey"].iloc[:1], "n": [len(pdf)]})

    return load(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(count, "k int, n long")


@query("map_in_arrow", "SELECT o_orderkey, o_totalprice > 250000 AS large FROM orders")
def map_in_arrow(spark, sf_dir):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.greater(b.column(1), 250000.0)], ["o_orderkey", "large"])

    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(mark, "o_orderkey long, large boolean")


@query("udaf_two_phase", """SELECT l_partkey, max(price) FILTER (WHERE k = 1) AS highest, max(price) FILTER (WHERE k = 2) AS second FROM (
SELECT l_partkey, price, row_number() OVER (PARTITION BY l_partkey ORDER BY price DESC) AS k FROM (SELECT DISTINCT l_partkey, l_extendedprice AS price FROM lineitem)) WHERE k <= 2 GROUP BY 1""")
def udaf_two_phase(spark, sf_dir):
    """An aggregate of our own, the two highest different values, with a partial state: a batch keeps two a key, and what is exchanged is sorted and merged batch by batch."""

    def two(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The two highest of each key, by key, and where the keys begin."""
        rows = t.group_by(["l_partkey", "price"]).aggregate([]).sort_by([("l_partkey", "ascending"), ("price", "descending")])
        key, null = (c.to_numpy() for c in (pc.fill_null(rows.column("l_partkey"), 0), pc.is_null(rows.column("l_partkey"))))
        first = np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])] if len(key) else np.zeros(0, bool)
        at = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        return rows.filter(pa.array(at < 2)).select(["l_partkey", "price"]), first[at < 2]

    def partial(batches):
        for b in batches:
            yield from two(pa.Table.from_batches([b]))[0].to_batches()

    def finish(rows: pa.Table, first: np.ndarray) -> list[pa.RecordBatch]:
        at = np.flatnonzero(first)
        after = pa.array(at + 1, mask=np.r_[first, True][at + 1])
        best = rows.take(pa.array(at))
        return pa.table({"l_partkey": best.column("l_partkey"), "highest": best.column("price"), "second": rows.column("price").take(after)}).to_batches()

    def merge(batches):
        """Batches come in order of keys; the last key of each may go on in the next."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rows, first = two(t if held is None else pa.concat_tables([held, t]))
            last = int(np.flatnonzero(first)[-1]) if len(first) else 0
            yield from finish(rows.slice(0, last), first[:last])
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield from finish(*two(held))

    rows = load(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("price")).mapInArrow(partial, "l_partkey long, price double")
    dealt = rows.repartition("l_partkey").sortWithinPartitions(F.asc_nulls_last("l_partkey"))
    return dealt.mapInArrow(merge, "l_partkey long, highest double, second double")


@query("udaf_median_deviation", "WITH m AS (SELECT o_custkey, median(o_totalprice) AS m FROM orders GROUP BY 1) SELECT o_custkey, round(median(abs(o_totalprice - m)), 4) AS deviation FROM orders JOIN m USING (o_custkey) GROUP BY 1")
def udaf_median_deviation(spark, sf_dir):
    """A vectorised aggregate over every customer's orders: the median of what they are off their median."""

    @F.pandas_udf("double")
    def deviation(s: pd.Series) -> float:
        return float((s - s.median()).abs().median())

    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(deviation("o_totalprice"), 4).alias("deviation"))


@query("cogroup_in_pandas", """SELECT c_custkey, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders,
(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000 * (SELECT avg(value) FROM events WHERE user_id = c_custkey)) AS large FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders UNION SELECT user_id FROM events)""")
def cogroup_in_pandas(spark, sf_dir):
    """Two tables grouped side by side: each customer's orders against the mean of the same customer's events. A group holds many customers, as many groups as the tables ask for."""

    def both(events: pd.DataFrame, orders: pd.DataFrame) -> pd.DataFrame:
        seen = events.groupby("user_id")["value"].agg(["size", "mean"])
        large = orders["o_totalprice"] > 1000 * orders["o_custkey"].map(seen["mean"])
        own = large.groupby(orders["o_custkey"]).agg(["size", "sum"])
        out = pd.DataFrame({"events": seen["size"], "orders": own["size"], "large": own["sum"]}).fillna(0).astype("int64")
        return out.rename_axis("c_custkey").reset_index()

    events = load(spark, sf_dir, "events").select("user_id", "value").where("user_id IS NOT NULL")
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").where("o_custkey IS NOT NULL")
    groups = F.lit(max(64, (events.count() + orders.count()) // 50_000))
    dealt = lambda df, key: df.groupBy(F.pmod(F.xxhash64(key), groups))
    out = dealt(events, "user_id").cogroup(dealt(orders, "o_custkey")).applyInPandas(both, "c_custkey long, events long, orders long, large long")
    return out.join(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
