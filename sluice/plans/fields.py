"""Field analytics on stand-in columns: what the pages only describe, with semantics of our own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators import folds, joins, zones
from sluice.registry import query
from sluice.sources.tables import load


@query("p01_indices", "SELECT p_partkey, round((p_retailprice - p_size) / (p_retailprice + p_size), 8) AS ndvi, round((p_retailprice - p_size) / (p_retailprice + p_size + 0.5) * 1.5, 8) AS savi FROM part", "P")
def indices(spark, sf_dir):
    """Normalised difference and soil-adjusted indices of two bands."""
    a, b = F.col("p_retailprice"), F.col("p_size").cast("double")
    return load(spark, sf_dir, "part").select("p_partkey", F.round(zones.normalized_difference(a, b), 8).alias("ndvi"), F.round(zones.soil_adjusted(a, b), 8).alias("savi"))


@query("p02_anomalies", "SELECT event_id, round((value - m) / s, 6) AS z FROM events JOIN (SELECT event_type AS t, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) ON t = event_type WHERE abs((value - m) / s) > 2", "P")
def anomalies(spark, sf_dir):
    """Values more than two deviations from their zone's mean."""
    return zones.anomalies(load(spark, sf_dir, "events"), "event_type", "value", 2.0).select("event_id", F.round("z", 6).alias("z"))


@query("p04_trend", "SELECT user_id, round(regr_slope(value, epoch_us(ts) / 86400000000.0), 6) AS slope FROM events GROUP BY 1", "P")
def trend(spark, sf_dir):
    """Change per day of each series."""
    day = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000.0)
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.regr_slope("value", day), 6).alias("slope"))


@query("p05_drop_alert", "SELECT event_id FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE value < 0.2 * m", "P")
def drop_alert(spark, sf_dir):
    """Values that fall far below the average of the same series so far."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return folds.running_mean_before(rows, "user_id", ("ts", "event_id"), "value", "m").where("value < 0.2 * m").select("event_id")


@query("p06_inspection_points", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE value > 20) WHERE rn <= 3", "P")
def inspection_points(spark, sf_dir):
    """The three worst anomalies of each zone."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return load(spark, sf_dir, "events").where("value > 20").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("user_id", "event_id")


@query("p09_supply_uptake", "SELECT n_nationkey, round(coalesce(s, 0) - coalesce(c, 0), 2) AS balance FROM nation LEFT JOIN (SELECT s_nationkey AS a, sum(s_acctbal) AS s FROM supplier GROUP BY 1) ON a = n_nationkey LEFT JOIN (SELECT c_nationkey AS b, sum(c_acctbal) AS c FROM customer GROUP BY 1) ON b = n_nationkey", "P")
def supply_uptake(spark, sf_dir):
    """Supply less uptake of each zone."""
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("s"))
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("c_acctbal").alias("c"))
    rows = load(spark, sf_dir, "nation").select("n_nationkey").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    return rows.select("n_nationkey", F.round(F.coalesce("s", F.lit(0.0)) - F.coalesce("c", F.lit(0.0)), 2).alias("balance"))


@query("p10_ratios", "SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0), 6) AS a_r FROM lineitem GROUP BY 1", "P")
def ratios(spark, sf_dir):
    """Ratio of two pivoted measures, null where either is missing."""
    wide = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "R"]).agg(F.sum("l_quantity"))
    return wide.select("l_orderkey", F.round(F.try_divide("A", "R"), 6).alias("a_r"))


@query("p11_stage_interpretation", "SELECT p_partkey, band FROM part JOIN (VALUES ('low', 0, 10), ('fair', 10, 30), ('good', 30, 1000)) AS t(band, lo, hi) ON p_size >= lo AND p_size < hi", "P")
def stage_interpretation(spark, sf_dir):
    """Values against a table of thresholds."""
    bands = spark.sql("SELECT * FROM VALUES ('low', 0, 10), ('fair', 10, 30), ('good', 30, 1000) AS t(band, lo, hi)")
    return joins.range_join(load(spark, sf_dir, "part"), bands, "p_size", "lo", "hi", 10.0).select("p_partkey", "band")


@query("p22_gaps", "SELECT user_id, ts, gap FROM (SELECT user_id, ts, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS gap FROM events) WHERE gap > 172800000000", "P")
def gap_report(spark, sf_dir):
    """Stretches of a row without anything for more than two days."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return zones.gaps(rows, "user_id", ("ts", "event_id"), "at", 172_800_000_000).select("user_id", "ts", "gap")


@query("p30_best_scenario", "SELECT l_returnflag, arg_max(l_linestatus, t) AS best FROM (SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1, 2) GROUP BY 1", "P")
def best_scenario(spark, sf_dir):
    """The scenario of each plot with the largest total."""
    totals = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_extendedprice").alias("t"))
    return totals.groupBy("l_returnflag").agg(F.max_by("l_linestatus", "t").alias("best"))


@query("p32_polygon_area", "SELECT p_partkey, CAST(p_size * p_size * 2 AS DOUBLE) AS area FROM part", "P")
def polygon_area(spark, sf_dir):
    """Area of a rectangle of one side and its double, by its vertices."""
    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    return load(spark, sf_dir, "part").select("p_partkey", zones.polygon_area(F.array(zero, s, s, zero), F.array(zero, zero, s * 2, s * 2)).alias("area"))


@query("p34_ledger", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN -round(value * 100) ELSE round(value * 100) END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS cents FROM events", "P")
def ledger(spark, sf_dir):
    """Applied less extracted so far on each plot, in whole cents."""
    cents = F.round(F.col("value") * 100).cast("long")
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return folds.running_total(rows, "user_id", ("ts", "event_id"), F.when(F.col("event_type") == "purchase", -cents).otherwise(cents), "cents").select("event_id", "cents")


@query("p36_zones", """WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), s AS (SELECT p_size, coalesce(sum(n) OVER (ORDER BY p_size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS share FROM c)
SELECT p_partkey, CASE WHEN share < 0.35 THEN 'A' WHEN share < 0.85 THEN 'B' ELSE 'C' END AS zone FROM part JOIN s USING (p_size)""", "P")
def productivity_zones(spark, sf_dir):
    """Zones of about 35, 50 and 15 percent of rows, highest values first."""
    return zones.zones_by_share(load(spark, sf_dir, "part"), "p_size", 1.0, {"A": 0.35, "B": 0.5, "C": 0.15}).select("p_partkey", "zone")


@query("p37_variability", "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS sd FROM part GROUP BY 1", "P")
def variability(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"))


@query("p39_deficit_alert", "SELECT date_trunc('day', ts) AS day, event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2 HAVING avg(value) < 45", "P")
def deficit_alert(spark, sf_dir):
    """Daily means under a threshold."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return load(spark, sf_dir, "events").groupBy(day, "event_type").agg(F.avg("value").alias("m")).where("m < 45").select("day", "event_type", F.round("m", 6).alias("mean"))


@query("p42_batch_limits", """WITH e AS (SELECT o_orderdate AS t, 1 AS d FROM orders UNION ALL SELECT o_orderdate + INTERVAL 3 DAY, -1 FROM orders), g AS (SELECT t, sum(d) AS d FROM e GROUP BY 1)
SELECT CAST(t AS DATE) AS day, CAST(sum(d) OVER (ORDER BY t) AS BIGINT) AS busy FROM g""", "P")
def batch_limits(spark, sf_dir):
    """How many three-day batches run at once: opening and closing counts by day, summed over the days, which are few."""
    o = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    edges = o.select("day", F.lit(1).alias("d")).unionByName(o.select(F.date_add("day", 3).alias("day"), F.lit(-1).alias("d")))
    return edges.groupBy("day").agg(F.sum("d").alias("d")).select("day", F.sum("d").over(Window.orderBy("day")).alias("busy"))


@query("p54_zone_policy", "SELECT p_partkey, CASE WHEN p_size > 33 THEN 'more' WHEN p_size > 16 THEN 'balanced' ELSE 'less' END AS policy FROM part", "P")
def zone_policy(spark, sf_dir):
    """Each zone's policy, from a lookup that is a literal of three rows."""
    zone = F.when(F.col("p_size") > 33, "A").when(F.col("p_size") > 16, "B").otherwise("C")
    policy = spark.sql("SELECT * FROM VALUES ('A', 'more'), ('B', 'balanced'), ('C', 'less') AS t(zone, policy)")
    return load(spark, sf_dir, "part").withColumn("zone", zone).join(F.broadcast(policy), "zone").select("p_partkey", "policy")


@query("p55_equal_within", "SELECT a.p_brand AS brand FROM (SELECT p_brand, avg(p_size) AS x FROM part GROUP BY 1) a WHERE abs(x - (SELECT avg(p_size) FROM part)) <= 0.05 * (SELECT avg(p_size) FROM part)", "P")
def equal_within(spark, sf_dir):
    """Groups whose mean equals the whole's within five percent."""
    p = load(spark, sf_dir, "part")
    whole = p.agg(F.avg("p_size").alias("w"))
    groups = p.groupBy("p_brand").agg(F.avg("p_size").alias("x"))
    return groups.crossJoin(F.broadcast(whole)).where(F.abs(F.col("x") - F.col("w")) <= 0.05 * F.col("w")).select(F.col("p_brand").alias("brand"))
