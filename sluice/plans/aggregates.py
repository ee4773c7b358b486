"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.registry import query
from sluice.sources.tables import load


@query("agg_basic", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS custs, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1")
def agg_basic(spark, sf_dir):
    price = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("custs"), F.round(F.avg(price), 4).alias("mean"), F.min(price).alias("lo"), F.max(price).alias("hi"), F.count_if(price > 200000).alias("large"))


@query("agg_moments", """SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 4) AS var, round(corr(value, event_id), 6) AS r, round(covar_samp(value, user_id), 4) AS cov, round(regr_slope(value, user_id), 8) AS slope FROM events GROUP BY 1""")
def agg_moments(spark, sf_dir):
    v = F.col("value")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.var_pop(v), 4).alias("var"), F.round(F.corr(v, F.col("event_id").cast("double")), 6).alias("r"),
        F.round(F.covar_samp(v, F.col("user_id").cast("double")), 4).alias("cov"), F.round(F.regr_slope(v, F.col("user_id").cast("double")), 8).alias("slope"))


@query("agg_shape", """WITH m AS (SELECT event_type AS t, avg(value) AS mean, var_pop(value) AS var FROM events GROUP BY 1)
SELECT event_type, round(avg(pow(value - mean, 3)) / pow(any_value(var), 1.5), 6) AS skew, round(avg(pow(value - mean, 4)) / pow(any_value(var), 2) - 3, 6) AS kurt FROM events JOIN m ON t = event_type GROUP BY 1""")
def agg_shape(spark, sf_dir):
    """Skewness and kurtosis by the population formulas."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.skewness("value"), 6).alias("skew"), F.round(F.kurtosis("value"), 6).alias("kurt"))


@query("agg_percentiles", "SELECT p_type, quantile_cont(p_size, 0.25) AS q1, median(p_size) AS med, min(m.mode) AS mode FROM part JOIN (SELECT p_type AS t, arg_min(p_size, rk) AS mode FROM (SELECT p_type, p_size, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_size) AS rk FROM part GROUP BY 1, 2) GROUP BY 1) m ON m.t = p_type GROUP BY 1")
def agg_percentiles(spark, sf_dir):
    size = F.col("p_size")
    return load(spark, sf_dir, "part").groupBy("p_type").agg(F.percentile(size, 0.25).alias("q1"), F.median(size).alias("med"), F.mode(size, True).alias("mode"))


@query("agg_collect", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, len(list(DISTINCT n_name)) AS n FROM nation GROUP BY 1")
def agg_collect(spark, sf_dir):
    """Lists of a dimension that is fixed at 25 rows."""
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.size(F.collect_set("n_name")).cast("long").alias("n"))


@query("agg_listagg", "SELECT r_name, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def agg_listagg(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows.createOrReplaceTempView("nation_region")
    return spark.sql("SELECT r_name, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation_region GROUP BY r_name")


@query("agg_arg", "SELECT p_brand, arg_min(p_name, p_partkey) AS first, arg_max(p_name, p_partkey) AS last FROM part GROUP BY 1")
def agg_arg(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("first"), F.max_by("p_name", "p_partkey").alias("last"))


@query("agg_bool", "SELECT c_nationkey, bool_and(c_acctbal > -900) AS every, bool_or(c_acctbal > 9900) AS some FROM customer GROUP BY 1")
def agg_bool(spark, sf_dir):
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.bool_and(F.col("c_acctbal") > -900).alias("every"), F.bool_or(F.col("c_acctbal") > 9900).alias("some"))


@query("agg_any_value", "SELECT n_regionkey, any_value(n_regionkey * 2) AS twice FROM nation GROUP BY 1")
def agg_any_value(spark, sf_dir):
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.any_value(F.col("n_regionkey") * 2).alias("twice"))


@query("agg_sketches")
def agg_sketches(spark, sf_dir):
    """Distinct counts, frequencies and quantiles by mergeable sketches of fixed size."""
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("hll"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("hll_sketch"), F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey")).alias("theta"),
        F.percentile_approx("l_extendedprice", 0.5, 10000).alias("median"), F.octet_length(F.count_min_sketch("l_partkey", F.lit(0.01), F.lit(0.95), F.lit(1))).alias("cms_bytes"))


@query("agg_quantile_sketch")
def agg_quantile_sketch(spark, sf_dir):
    """Quantiles of all from mergeable sketches of days, each taken once."""
    days = load(spark, sf_dir, "lineitem").groupBy("l_shipdate", "l_returnflag").agg(F.kll_sketch_agg_double("l_extendedprice").alias("sketch"))
    merged = days.groupBy("l_returnflag").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select("l_returnflag", F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median"), F.kll_sketch_get_quantile_double("sketch", F.lit(0.9)).alias("p90"))


@query("agg_grouping_sets", "SELECT o_orderstatus AS s, o_orderpriority AS p, grouping(o_orderstatus, o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def agg_grouping_sets(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    sets = [[F.col("o_orderstatus"), F.col("o_orderpriority")], [F.col("o_orderstatus")], []]
    return o.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("g"), F.count("*").alias("n")).select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), "g", "n")


@query("agg_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@query("agg_rollup", "SELECT r_name, n_name, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)", "D")
def agg_rollup(spark, sf_dir):
    """A report with subtotals."""
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("agg_pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY 1")
def agg_pivot(spark, sf_dir):
    wide = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count()
    return wide.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("o"), F.coalesce("F", F.lit(0)).alias("f"))


@query("agg_unpivot", "SELECT p_partkey, 'size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def agg_unpivot(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot("p_partkey", ["size", "price"], "name", "value")


@query("agg_transpose", "SELECT 'n' AS key, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders")
def agg_transpose(spark, sf_dir):
    """A table of three rows turned on its side."""
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderstatus").transpose("o_orderstatus")
