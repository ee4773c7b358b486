"""Window functions and top-k per group."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators import folds, ranking
from sluice.registry import query
from sluice.sources.tables import load


@query("window_ranks", """SELECT p_partkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), v AS (PARTITION BY p_brand ORDER BY p_size)""")
def window_ranks(spark, sf_dir):
    """All ranks from counts of each value: rows are numbered among equals, in cells of 4096 keys, so neither a brand nor a value of it is a single task."""
    part = load(spark, sf_dir, "part")
    counts = part.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy("p_brand").orderBy("p_size"), Window.partitionBy("p_brand")
    place = counts.select("p_brand", "p_size", "n", (F.sum("n").over(up) - F.col("n")).alias("less"), F.row_number().over(up).alias("dense"), F.sum("n").over(whole).alias("total"))
    cell = F.floor(F.col("p_partkey") / 4096)
    before = Window.partitionBy("p_brand", "p_size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = part.groupBy("p_brand", "p_size", cell.alias("cell")).agg(F.count("*").alias("k")).withColumn("earlier", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    own = F.row_number().over(Window.partitionBy("p_brand", "p_size", "cell").orderBy("p_partkey"))
    rows = part.withColumn("cell", cell).withColumn("own", own).join(cells, ["p_brand", "p_size", "cell"]).join(place, ["p_brand", "p_size"]).withColumn("rn", F.col("less") + F.col("earlier") + F.col("own"))
    base, rest, rn = F.floor(F.col("total") / 4), F.col("total") % 4, F.col("rn")
    tile = F.when(rn <= rest * (base + 1), F.ceil(rn / (base + 1))).otherwise(rest + F.ceil(F.try_divide(rn - rest * (base + 1), base)))
    percent = F.when(F.col("total") > 1, F.col("less") / (F.col("total") - 1)).otherwise(0.0)
    big = lambda c: c.cast("long")
    return rows.select(
        "p_partkey", big(rn).alias("rn"), big(F.col("less") + 1).alias("rk"), big(F.col("dense")).alias("dr"), big(tile).alias("nt"),
        F.round(percent, 6).alias("pr"), F.round((F.col("less") + F.col("n")) / F.col("total"), 6).alias("cd"))


@query("window_offsets", """SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after, first_value(value) OVER w AS first, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(value, 2) OVER w AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_offsets(spark, sf_dir):
    """Neighbours and ends of each user's series, day by day with what other days hold, so that a user is no single task."""
    rows = folds.with_neighbours(load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ("ts", "event_id"), "value", 1, 2, ends=True)
    nth = lambda c, i: F.get(c, F.lit(i))["v"]
    return rows.select(
        "event_id", nth("_before", 0).alias("before"), F.when(F.size("_after") == 2, nth("_after", 1)).otherwise(-1.0).alias("after"),
        nth("_firsts", 0).alias("first"), nth("_lasts", 0).alias("last"), F.when(F.col("_rank") >= 2, nth("_firsts", 1)).alias("second"))


@query("window_frames", """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving,
count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS day_count FROM events""")
def window_frames(spark, sf_dir):
    """A sliding frame of rows, and one of time: rows stand in their own day and, to be counted only, in the next."""
    rows = folds.with_neighbours(load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ("ts", "event_id"), "value", 3, 0)
    frame = F.concat("_before", F.array(F.struct(F.col("value").alias("v"))))
    moving = F.aggregate(frame, F.lit(0.0), lambda s, x: s + x["v"]) / F.size(frame)
    micros, day = F.unix_micros(F.col("ts").cast("timestamp")), 86_400_000_000
    both = rows.select("user_id", "event_id", moving.alias("moving"), micros.alias("at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("later")).withColumn("bucket", F.floor(F.col("at") / day) + F.col("later"))
    span = Window.partitionBy("user_id", "bucket").orderBy("at").rangeBetween(-day, 0)
    return both.withColumn("day_count", F.count("*").over(span)).where("later = 0").select("event_id", F.round("moving", 6).alias("moving"), "day_count")


@query("window_share", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders")
def window_share(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 8).alias("share"))


@query("top_k_per_group", "SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_k_per_group(spark, sf_dir):
    """Each customer's three largest orders; the group limit is pushed below the shuffle."""
    return ranking.top_k(load(spark, sf_dir, "orders"), "o_custkey", 3, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query("sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid""")
def sessions(spark, sf_dir):
    """Sessions that end after twelve idle hours; the gaps and the running count of sessions go day by day."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    rows = folds.with_neighbours(rows, "user_id", ("ts", "event_id"), "at", 1, 0)
    new = F.when(F.col("at") - F.get("_before", F.lit(0))["v"] <= 12 * 3600 * 1_000_000, 0).otherwise(1)
    rows = folds.running_total(rows.select("user_id", "event_id", "ts", new.alias("new")), "user_id", ("ts", "event_id"), F.col("new"), "sid")
    return rows.groupBy("user_id", "sid").agg(F.min("ts").alias("started"), F.count("*").alias("n")).drop("sid")
