"""More field analytics on stand-in columns, with semantics of our own: places, zones, sampling, prescriptions.

Parts, suppliers and customers stand at places made from their keys, and each of
the 25 nations is a box on the map.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators import folds, zones
from sluice.registry import query
from sluice.sources.tables import load, round_trip


def _at(df, key, *names):
    """df with its rows' places on a map of 100 by 100."""
    x, y = names or ("x", "y")
    return df.withColumns({x: F.col(key) * 37 % 1000 / 10.0, y: F.col(key) * 91 % 1000 / 10.0})


def _boxes(spark, sf_dir):
    """Boxes of 15 to 23 by 18, in five columns; neighbours overlap or leave gaps."""
    k = F.col("n_nationkey")
    x0, y0 = k % 5 * 20.0, F.floor(k / 5) * 20.0
    return load(spark, sf_dir, "nation").select("n_nationkey", x0.alias("x0"), y0.alias("y0"), (x0 + 15 + k % 9).alias("x1"), (y0 + 18).alias("y1"))


BOXES = "boxes AS (SELECT n_nationkey, n_nationkey % 5 * 20.0 AS x0, n_nationkey // 5 * 20.0 AS y0, n_nationkey % 5 * 20.0 + 15 + n_nationkey % 9 AS x1, n_nationkey // 5 * 20.0 + 18 AS y1 FROM nation)"
PARTS = "points AS (SELECT *, p_partkey * 37 % 1000 / 10.0 AS x, p_partkey * 91 % 1000 / 10.0 AS y FROM part)"


@query("p03_stress_kind", "SELECT p_partkey, CASE WHEN p_size < 15 AND p_retailprice < 1200 THEN 'water' WHEN p_size < 15 THEN 'nutrient' WHEN p_retailprice < 1000 THEN 'disease' ELSE 'none' END AS stress FROM part", "P")
def stress_kind(spark, sf_dir):
    """Kinds of stress by rules over two indices."""
    low, size = F.col("p_retailprice"), F.col("p_size")
    kind = F.when((size < 15) & (low < 1200), "water").when(size < 15, "nutrient").when(low < 1000, "disease").otherwise("none")
    return load(spark, sf_dir, "part").select("p_partkey", kind.alias("stress"))


@query("p07_cross_check", """WITH a AS (SELECT user_id AS z, count(*) AS n FROM events WHERE value > 90 GROUP BY 1), s AS (SELECT o_custkey AS z, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS anomalies, round(m, 7) AS soil, coalesce(n, 0) > 0 AND coalesce(m, 0) < 150000 AS confirmed FROM customer LEFT JOIN a ON a.z = c_custkey LEFT JOIN s ON s.z = c_custkey""", "P")
def cross_check(spark, sf_dir):
    """Anomalies confirmed by a second source: both are aggregated before they are joined to the zones."""
    a = load(spark, sf_dir, "events").where("value > 90").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    s = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"))
    rows = load(spark, sf_dir, "customer").select("c_custkey").join(a, "c_custkey", "left").join(s, "c_custkey", "left")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0.0))
    return rows.select("c_custkey", n.alias("anomalies"), F.round("m", 7).alias("soil"), ((n > 0) & (m < 150000)).alias("confirmed"))


@query("p08_sample_zones", f"WITH {BOXES}, {PARTS} SELECT p_partkey, n_nationkey FROM points JOIN boxes ON x >= x0 AND x < x1 AND y >= y0 AND y < y1", "P")
def sample_zones(spark, sf_dir):
    """Every zone that a sample's place lies in."""
    points = _at(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return zones.within_boxes(points, _boxes(spark, sf_dir), 10.0).select("p_partkey", "n_nationkey")


@query("p12_history", "SELECT event_id, count(*) OVER w AS n, round(value - lag(value) OVER w, 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "P")
def history(spark, sf_dir):
    """Each sample's number in its place's history, and the change since the one before."""
    rows = folds.with_neighbours(load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ("ts", "event_id"), "value", 1, 0)
    return rows.select("event_id", F.col("_rank").alias("n"), F.round(F.col("value") - F.get("_before", F.lit(0))["v"], 6).alias("change"))


@query("p13_sampling_plan", """WITH z AS (SELECT p_brand, count(*) * stddev_pop(p_retailprice) AS w FROM part GROUP BY 1), t AS (SELECT sum(w) AS t FROM z),
r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey * 7919 % 10007, p_partkey) AS rn FROM part)
SELECT p_partkey, p_brand FROM r JOIN z USING (p_brand), t WHERE rn <= ceil(60 * w / t)""", "P")
def sampling_plan(spark, sf_dir):
    """About sixty places, more where values vary more: a zone's share is its rows times their deviation."""
    part = load(spark, sf_dir, "part")
    stats = part.groupBy("p_brand").agg((F.count("*") * F.stddev_pop("p_retailprice")).alias("w"))
    share = stats.withColumn("take", F.ceil(60 * F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1))))).select("p_brand", "take")
    # Sixty and one for each zone bound what any zone can take, so the group limit reaches below the shuffle.
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_partkey") * 7919 % 10007, "p_partkey"))
    return part.select("p_brand", "p_partkey").withColumn("rn", rank).where("rn <= 61").join(F.broadcast(share), "p_brand").where("rn <= take").select("p_partkey", "p_brand")


@query("p14_panel", """SELECT l_orderkey, 'quantity' AS measure, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'discount', round(avg(l_discount), 6) FROM lineitem GROUP BY 1
UNION ALL SELECT l_orderkey, 'tax', round(avg(l_tax), 6) FROM lineitem GROUP BY 1""", "P")
def panel(spark, sf_dir):
    """A panel of measures, wide to long; the means are taken while it is wide."""
    wide = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.avg(f"l_{c}").alias(c) for c in ("quantity", "discount", "tax")))
    return wide.unpivot("l_orderkey", ["quantity", "discount", "tax"], "measure", "mean").select("l_orderkey", "measure", F.round("mean", 6).alias("mean"))


@query("p15_interpolation", f"""WITH {BOXES}, {PARTS}, o AS (SELECT c_custkey * 37 % 1000 / 10.0 AS ox, c_custkey * 91 % 1000 / 10.0 AS oy, c_acctbal AS v FROM customer),
d AS (SELECT p_partkey, v, sqrt(pow(x - ox, 2) + pow(y - oy, 2)) AS d FROM points JOIN o ON abs(x - ox) <= 7 AND abs(y - oy) <= 7)
SELECT p_partkey, round(sum(v / (d * d + 1)) / sum(1 / (d * d + 1)), 4) AS estimate, count(*) AS n FROM d WHERE d <= 7 GROUP BY 1""", "P")
def interpolation(spark, sf_dir):
    """Each place's value, weighted by inverse squared distance from the samples within seven; places that several rows share are joined once."""
    points = _at(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    samples = _at(load(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), "c_custkey", "ox", "oy")
    samples = samples.groupBy("ox", "oy").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    w = 1 / (F.col("distance") * F.col("distance") + 1)
    places = zones.nearby(points.select("x", "y").distinct(), samples, 7.0).groupBy("x", "y").agg((F.sum(F.col("v") * w) / F.sum(F.col("n") * w)).alias("estimate"), F.sum("n").alias("n"))
    return points.join(places, ["x", "y"]).select("p_partkey", F.round("estimate", 4).alias("estimate"), "n")


@query("p16_zone_validation", """WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM part GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS m FROM g)
SELECT round(sum(n * v) / (sum(n * v) + sum(n * pow(g.m - t.m, 2))), 6) AS inside FROM g, t""", "P")
def zone_validation(spark, sf_dir):
    """The share of all variance that lies within zones; from one row of moments for each zone."""
    g = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("m"), F.var_pop("p_retailprice").alias("v"))
    n, m = F.col("n"), F.col("m")
    s = g.agg(F.sum(n * F.col("v")).alias("inside"), F.sum(n * m * m).alias("squares"), F.sum(n * m).alias("sums"), F.sum(n).alias("rows"))
    between = F.col("squares") - F.col("sums") * F.col("sums") / F.col("rows")
    return s.select(F.round(F.col("inside") / (F.col("inside") + between), 6).alias("inside"))


@query("p23_spacing", """SELECT user_id, count(*) AS n, round(sum(abs(gap - 6)), 4) AS off, round(sum(abs(gap - 6)) * 1.5, 4) AS loss
FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3600000000.0 AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1""", "P")
def spacing(spark, sf_dir):
    """How far spacings are off six, in all, and what that costs."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    gap = (F.col("at") - F.get("_before", F.lit(0))["v"]) / 3_600_000_000
    rows = folds.with_neighbours(rows, "user_id", ("ts", "event_id"), "at", 1, 0).select("user_id", gap.alias("gap")).where("gap IS NOT NULL")
    off = F.sum(F.abs(F.col("gap") - 6))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(off, 4).alias("off"), F.round(off * 1.5, 4).alias("loss"))


@query("p24_density", f"WITH {BOXES}, {PARTS} SELECT n_nationkey, count(p_partkey) AS plants, round(count(p_partkey) / ((x1 - x0) * (y1 - y0)), 8) AS density FROM boxes LEFT JOIN points ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY n_nationkey, x0, x1, y0, y1", "P")
def density(spark, sf_dir):
    """Plants per unit of area of each zone, empty ones too."""
    boxes = _boxes(spark, sf_dir)
    counts = zones.within_boxes(_at(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey"), boxes, 10.0).groupBy("n_nationkey").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return boxes.join(counts, "n_nationkey", "left").select("n_nationkey", n.alias("plants"), F.round(n / area, 8).alias("density"))


@query("p25_slope", f"""WITH {PARTS}, g AS (SELECT floor(x / 5) AS cx, floor(y / 5) AS cy, avg(p_retailprice) AS h FROM points GROUP BY 1, 2)
SELECT CAST(a.cx AS BIGINT) AS cx, CAST(a.cy AS BIGINT) AS cy, round(sqrt(pow((e.h - a.h) / 5, 2) + pow((n.h - a.h) / 5, 2)), 6) AS slope FROM g a JOIN g e ON e.cx = a.cx + 1 AND e.cy = a.cy JOIN g n ON n.cx = a.cx AND n.cy = a.cy + 1""", "P")
def slope(spark, sf_dir):
    """Slope of each cell of an elevation grid from its two neighbours; a cell gives its height to them in one grouping, not a join."""
    grid = _at(load(spark, sf_dir, "part"), "p_partkey").groupBy(F.floor(F.col("x") / 5).alias("cx"), F.floor(F.col("y") / 5).alias("cy")).agg(F.avg("p_retailprice").alias("h"))
    to = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), (F.col("cx") - dx).alias("cx"), (F.col("cy") - dy).alias("cy"), "h") for r, dx, dy in (("own", 0, 0), ("east", 1, 0), ("north", 0, 1)))))
    wide = grid.select(to.alias("t")).select("t.*").groupBy("cx", "cy").pivot("role", ["own", "east", "north"]).agg(F.first("h")).dropna()
    rise = lambda c: F.pow((F.col(c) - F.col("own")) / 5, 2)
    return wide.select("cx", "cy", F.round(F.sqrt(rise("east") + rise("north")), 6).alias("slope"))


@query("p29_site_inputs", "SELECT o_orderkey, n_name AS texture, r_name AS rainfall, CASE WHEN c_mktsegment = 'MACHINERY' THEN 12 ELSE 6 END AS width FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", "P")
def site_inputs(spark, sf_dir):
    """Each job with what is known of its site, from dimension tables."""
    names = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.col("n_name").alias("texture"), F.col("r_name").alias("rainfall"))
    sites = load(spark, sf_dir, "customer").join(F.broadcast(names), F.col("n_nationkey") == F.col("c_nationkey"))
    width = F.when(F.col("c_mktsegment") == "MACHINERY", 12).otherwise(6)
    return load(spark, sf_dir, "orders").join(sites, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "texture", "rainfall", width.alias("width"))


@query("p31_boundaries", "SELECT p_partkey, CAST(p_size * (p_size + 4) - p_size * 4 / 2.0 AS DOUBLE) AS area, round(p_size + 2 * p_size + 4 + p_size + sqrt(p_size * p_size + 16) - p_size, 6) AS perimeter FROM part", "P")
def boundaries(spark, sf_dir):
    """Area and perimeter of boundaries read from text: a box of s by s + 4 whose upper side slants down to s."""
    s, t = F.col("p_size").cast("string"), (F.col("p_size") + 4).cast("string")
    text = F.concat(F.lit("POLYGON((0 0,"), s, F.lit(" 0,"), s, F.lit(" "), s, F.lit(",0 "), t, F.lit("))"))
    pairs = F.split(F.regexp_extract(text, r"\(\((.*)\)\)", 1), ",")
    axis = lambda k: F.transform(pairs, lambda p: F.split(p, " ")[k].cast("double"))
    xs, ys = axis(0), axis(1)
    return load(spark, sf_dir, "part").select("p_partkey", zones.polygon_area(xs, ys).alias("area"), F.round(zones.polygon_perimeter(xs, ys), 6).alias("perimeter"))


@query("p33_dose", "WITH s AS (SELECT n_nationkey AS z, avg(s_acctbal) AS soil FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT c_custkey, round(greatest(0, 4000 + c_acctbal * 0.5 - coalesce(soil, 0)) / 0.8, 7) AS dose FROM customer JOIN s ON z = c_nationkey", "P")
def dose(spark, sf_dir):
    """What a yield goal needs less what the soil test of the zone gives, over the efficiency; never below zero."""
    soil = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.avg("s_acctbal").alias("soil"))
    need = 4000 + F.col("c_acctbal") * 0.5 - F.coalesce("soil", F.lit(0.0))
    return load(spark, sf_dir, "customer").join(soil, "c_nationkey", "left").select("c_custkey", F.round(F.greatest(F.lit(0.0), need) / 0.8, 7).alias("dose"))


@query("p35_cutoff", "SELECT p_partkey, spent FROM (SELECT p_partkey, CAST(sum(p_size) OVER (ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM part) WHERE spent <= 5000", "P")
def cutoff(spark, sf_dir):
    """Input goes where return is highest until the budget is spent."""
    return zones.take_until(load(spark, sf_dir, "part"), "p_retailprice", "p_size", "p_partkey", 5000, 10).select("p_partkey", F.col("spent").cast("long").alias("spent"))


@query("p41_three_ways", """WITH w AS (SELECT user_id AS k, avg(value) AS water FROM events GROUP BY 1), t AS (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c_custkey, round(water, 6) AS water, top, c_mktsegment AS texture FROM customer LEFT JOIN w ON w.k = c_custkey LEFT JOIN t ON t.k = c_custkey WHERE water < 50 OR top > 300000""", "P")
def three_ways(spark, sf_dir):
    """Water, height and texture of a plot side by side, where one of them calls for a look."""
    w = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.avg("value").alias("water"))
    t = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("texture")).join(w, "c_custkey", "left").join(t, "c_custkey", "left")
    return rows.where("water < 50 OR top > 300000").select("c_custkey", F.round("water", 6).alias("water"), "top", "texture")


@query("p42_batch_admission", """WITH b AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice / 50) AS BIGINT) AS litres FROM orders), ok AS (SELECT * FROM b WHERE litres >= 1000),
e AS (SELECT day, litres AS d FROM ok UNION ALL SELECT day + 3, -litres FROM ok), g AS (SELECT CAST(day AS DATE) AS day, sum(d) AS d FROM e GROUP BY 1)
SELECT day, CAST(sum(d) OVER (ORDER BY day) AS BIGINT) AS litres, sum(d) OVER (ORDER BY day) > 6000 AS over FROM g""", "P")
def batch_admission(spark, sf_dir):
    """Batches of a thousand litres at least, each for three days: what stands at once, and whether that is over six thousand."""
    ok = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") / 50).alias("litres")).where("litres >= 1000")
    edges = ok.select("day", F.col("litres").alias("d")).unionByName(ok.select(F.date_add("day", 3).alias("day"), (-F.col("litres")).alias("d")))
    busy = F.sum("d").over(Window.orderBy("day"))
    return edges.groupBy("day").agg(F.sum("d").alias("d")).select("day", busy.alias("litres"), (busy > 6000).alias("over"))


@query("p43_sample_register", "SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1", "P")
def sample_register(spark, sf_dir):
    """The register of places that are sampled again and again: how often, since when, and what was last found."""
    at = F.struct("ts", "event_id")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("value", at).alias("last"))


@query("p44_prescription_file", "SELECT p_partkey, CASE WHEN p_size > 33 THEN 50 WHEN p_size > 16 THEN 100 ELSE 150 END AS rate FROM part", "P")
def prescription_file(spark, sf_dir):
    """Maps are written, read by the next step, and turned to rates."""
    maps = round_trip(load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 33, "A").when(F.col("p_size") > 16, "B").otherwise("C").alias("zone")), "parquet")
    rate = F.when(F.col("zone") == "A", 50).when(F.col("zone") == "B", 100).otherwise(150)
    return maps.select("p_partkey", rate.alias("rate"))


@query("p46_planter_quality", """WITH g AS (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 3600000000.0 AS gap FROM events)
SELECT user_id, round(count(*) FILTER (WHERE gap > 24) / count(*), 6) AS wide, count(*) FILTER (WHERE gap > 24) > 0.2 * count(*) AS poor FROM g WHERE gap IS NOT NULL GROUP BY 1""", "P")
def planter_quality(spark, sf_dir):
    """The share of spacings over a day in each row, and rows with more than a fifth of them."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    near = folds.with_neighbours(rows, "user_id", ("ts", "event_id"), "at", 0, 1).where(F.size("_after") > 0)
    wide = F.count(F.when(F.get("_after", F.lit(0))["v"] - F.col("at") > 24 * 3_600_000_000, 1))
    return near.groupBy("user_id").agg(F.round(wide / F.count("*"), 6).alias("wide"), (wide > 0.2 * F.count("*")).alias("poor"))


@query("p47_report", "SELECT c_mktsegment, n_regionkey, count(*) AS n, round(sum(o_totalprice), 2) AS money FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (c_mktsegment, n_regionkey)", "P")
def report(spark, sf_dir):
    """Counts and money by two levels, with subtotals."""
    sites = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(sites, F.col("c_custkey") == F.col("o_custkey"))
    return rows.rollup("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("money"))


@query("p49_export", "SELECT s_suppkey, s_name, s_acctbal FROM supplier", "P")
def export(spark, sf_dir):
    """A table exported with a header line and read back."""
    return round_trip(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "csv", header="true")


@query("p50_rotation", "SELECT c_custkey, CASE (c_custkey + 1) % 3 WHEN 0 THEN 'soy' WHEN 1 THEN 'maize' ELSE 'cover' END AS next_crop, r_name AS irrigation FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", "P")
def rotation(spark, sf_dir):
    """The next crop of each plot, by position in the rotation, and its zone's plan."""
    crops = spark.sql("SELECT * FROM VALUES (0, 'soy'), (1, 'maize'), (2, 'cover') AS t(turn, next_crop)")
    zone = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.col("r_name").alias("irrigation"))
    plots = load(spark, sf_dir, "customer").withColumn("turn", (F.col("c_custkey") + 1) % 3)
    return plots.join(F.broadcast(crops), "turn").join(F.broadcast(zone), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "next_crop", "irrigation")


@query("p51_zone_sampling", """WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), s AS (SELECT p_size, coalesce(sum(n) OVER (ORDER BY p_size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS share FROM c),
z AS (SELECT p_partkey, CASE WHEN share < 0.35 THEN 'A' WHEN share < 0.85 THEN 'B' ELSE 'C' END AS zone FROM part JOIN s USING (p_size)),
r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY p_partkey * 7919 % 10007, p_partkey) AS rn FROM z) SELECT p_partkey, zone FROM r WHERE rn <= CASE zone WHEN 'A' THEN 5 WHEN 'B' THEN 10 ELSE 20 END""", "P")
def zone_sampling(spark, sf_dir):
    """More places where productivity is low: five, ten and twenty by zone."""
    rows = zones.zones_by_share(load(spark, sf_dir, "part"), "p_size", 1.0, {"A": 0.35, "B": 0.5, "C": 0.15}).select("p_partkey", "zone")
    rank = F.row_number().over(Window.partitionBy("zone").orderBy(F.col("p_partkey") * 7919 % 10007, "p_partkey"))
    take = F.when(F.col("zone") == "A", 5).when(F.col("zone") == "B", 10).otherwise(20)
    # The plain bound is what reaches below the shuffle.
    return rows.withColumn("rn", rank).where("rn <= 20").where(F.col("rn") <= take).select("p_partkey", "zone")


@query("p52_irrigation", """WITH d AS (SELECT user_id % 7 AS zone, date_trunc('day', ts) AS day, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT zone, CAST(count(*) FILTER (WHERE m < 50) AS BIGINT) AS days, round(sum(greatest(0, 50 - m)), 4) AS water, max(50 - m) >= 5 AS large FROM d GROUP BY 1""", "P")
def irrigation(spark, sf_dir):
    """How much each zone lacks, day by day, and so how large its irrigation has to be."""
    d = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("zone"), F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("m"))
    lack = 50 - F.col("m")
    return d.groupBy("zone").agg(F.count(F.when(lack > 0, 1)).alias("days"), F.round(F.sum(F.greatest(F.lit(0.0), lack)), 4).alias("water"), (F.max(lack) >= 5).alias("large"))
