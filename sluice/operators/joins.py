"""Joins that have no method of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, tie: str, bucket: str = "day") -> DataFrame:
    """left with the value of the latest right row of the same key that isn't later; of equal times, that of the largest tie.

    Rows are windowed within (key, time bucket), so that a key with much of the
    data is spread over its buckets; what earlier buckets leave behind is carried over
    a table of one row per key and bucket.
    """
    out = left.columns
    trunc = lambda c: F.date_trunc(bucket, F.col(c).cast("timestamp"))
    best = F.struct(F.col(right_time).alias("t"), F.col(tie).alias("tie"), F.col(value).alias("v"))
    a = left.select(F.struct(*left.columns).alias("row"), F.col(by).alias("k"), F.col(left_time).alias("at"), trunc(left_time).alias("b"), F.lit(None).alias("r"), F.lit(1).alias("side"))
    b = right.select(F.lit(None).alias("row"), F.col(by).alias("k"), F.col(right_time).alias("at"), trunc(right_time).alias("b"), best.alias("r"), F.lit(0).alias("side"))
    both = a.unionByName(b)
    inside = Window.partitionBy("k", "b").orderBy("at", "side", "r.tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy("k", "b").agg(F.max("r").alias("last")).select("k", "b", F.last("last", ignorenulls=True).over(before).alias("carry"))
    seen = both.withColumn("seen", F.last("r", ignorenulls=True).over(inside)).where("side = 1")
    got = F.coalesce("seen", "carry")
    return seen.join(carry, ["k", "b"], "left").select(*(F.col(f"row.{c}").alias(c) for c in out), got["t"].alias("matched_at"), got["v"].alias("matched"))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, as an equi-join on buckets of width; a range is repeated once for each bucket it meets."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_b").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_b")
