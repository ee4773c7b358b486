"""Places, boundaries, water and batches: field work that takes more than one pass, on stand-in columns."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.window import Window

from sluice.functions import html as H
from sluice.operators import estimates, graphs, nearest, polygons
from sluice.plans.pages import LINKS_SQL
from sluice.registry import query
from sluice.sources import segments
from sluice.sources.tables import load, round_trip
from sluice.streaming import bounded


def _spread(key, odd):
    """A coordinate on a map of 100, of its own for each key: the key's multiple of an odd number, in 32 bits."""
    return F.col(key) % 2147483648 * odd % 4294967296 / 4294967296.0 * 100


def _placed(df, key, x="x", y="y"):
    return df.withColumns({x: _spread(key, 2654435761), y: _spread(key, 2246822519)})


PLACE = "{k} % 2147483648 * 2654435761 % 4294967296 / 4294967296.0::DOUBLE * 100 AS {x}, {k} % 2147483648 * 2246822519 % 4294967296 / 4294967296.0::DOUBLE * 100 AS {y}"
POINTS = f"points AS (SELECT p_partkey, {PLACE.format(k='p_partkey', x='x', y='y')} FROM part)"


@query("p15_nearest", f"""WITH {POINTS}, o AS (SELECT c_custkey, c_acctbal AS v, {PLACE.format(k='c_custkey', x='ox', y='oy')} FROM customer),
d AS (SELECT p_partkey, c_custkey, v, (x - ox) * (x - ox) + (y - oy) * (y - oy) AS d2 FROM points, o), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d2, c_custkey) AS rank FROM d)
SELECT p_partkey, round(sum(v / (d2 + 1)) / sum(1 / (d2 + 1)), 4) AS estimate, count(*) AS n, round(max(d2), 6) AS farthest FROM r WHERE rank <= 8 GROUP BY 1""", "P")
def interpolation_nearest(spark, sf_dir):
    """A value for each place from its eight nearest samples, weighted by inverse squared distance."""
    points = _placed(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    samples = _placed(load(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), "c_custkey", "ox", "oy")
    near = nearest.k_nearest(points, samples, 8, "p_partkey", "c_custkey")
    w = 1 / (F.col("d2") + 1)
    return near.groupBy("p_partkey").agg(F.round(F.sum(F.col("v") * w) / F.sum(w), 4).alias("estimate"), F.count("*").alias("n"), F.round(F.max("d2"), 6).alias("farthest"))


def _plots(spark, sf_dir):
    """Each nation's plot as text: a notched boundary with a hole, in a map of five by five."""
    k, x, y = F.col("n_nationkey"), F.col("n_nationkey") % 5 * 20, F.floor(F.col("n_nationkey") / 5) * 20
    at = lambda dx, dy: F.concat((x + dx).cast("string"), F.lit(" "), (y + dy).cast("string"))
    outer = F.concat_ws(",", at(1, 1), at(18, 2), at(F.lit(17), 18), at(F.lit(9), 7 + k % 6), at(2, 17), at(1, 1))
    hole = F.concat_ws(", ", at(8, 3), at(11, 3), at(11, 5), at(8, 5), at(8, 3))
    return load(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("POLYGON (("), outer, F.lit("), ("), hole, F.lit("))")).alias("wkt"))


VERTICES = """v AS (SELECT n_nationkey, ring, i, n_nationkey % 5 * 20 + dx AS x, n_nationkey // 5 * 20 + CASE WHEN dy < 0 THEN 7 + n_nationkey % 6 ELSE dy END AS y
  FROM nation, (VALUES (0, 0, 1, 1), (0, 1, 18, 2), (0, 2, 17, 18), (0, 3, 9, -1), (0, 4, 2, 17), (1, 0, 8, 3), (1, 1, 11, 3), (1, 2, 11, 5), (1, 3, 8, 5)) AS t(ring, i, dx, dy)),
e AS (SELECT a.n_nationkey, a.ring, CAST(a.x AS DOUBLE) AS ax, CAST(a.y AS DOUBLE) AS ay, CAST(b.x AS DOUBLE) AS ex, CAST(b.y AS DOUBLE) AS ey FROM v a JOIN v b ON a.n_nationkey = b.n_nationkey AND a.ring = b.ring AND b.i = (a.i + 1) % CASE a.ring WHEN 0 THEN 5 ELSE 4 END)"""


@query("p31_polygons", f"""WITH {VERTICES}, r AS (SELECT n_nationkey, ring, abs(sum(ax * ey - ex * ay)) / 2 AS area, sum(sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay))) AS len FROM e GROUP BY 1, 2)
SELECT n_nationkey, sum(CASE ring WHEN 0 THEN area ELSE -area END) AS area, round(sum(len), 6) AS perimeter, (SELECT count(*) FROM e WHERE e.n_nationkey = r.n_nationkey) AS edges FROM r GROUP BY 1""", "P")
def digitised(spark, sf_dir):
    """Boundaries with holes, read from text: area, length of all edges, and how many these are."""
    rings = _plots(spark, sf_dir).withColumn("rings", polygons.rings(F.col("wkt"))).withColumn("edges", polygons.edges(F.col("rings")))
    return rings.select("n_nationkey", polygons.area(F.col("rings")).alias("area"), F.round(polygons.perimeter(F.col("edges")), 6).alias("perimeter"), F.size("edges").cast("long").alias("edges"))


@query("p08_polygon_zones", f"""WITH {POINTS}, {VERTICES}, s AS (SELECT c_custkey, {PLACE.format(k='c_custkey', x='x', y='y')} FROM customer),
pts AS (SELECT 'part' AS kind, p_partkey AS k, x, y FROM points UNION ALL SELECT 'customer', c_custkey, x, y FROM s)
SELECT kind, k, n_nationkey FROM pts, e WHERE (ay > y) <> (ey > y) AND x < (ex - ax) * (y - ay) / (ey - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1""", "P")
def polygon_zones(spark, sf_dir):
    """The plot that each sample's place lies in: notched plots with holes, joined by covering cells."""
    parts = _placed(load(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("k")), "k")
    customers = _placed(load(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k")), "k")
    plots = _plots(spark, sf_dir).select("n_nationkey", polygons.edges(polygons.rings(F.col("wkt"))).alias("edges"))
    return polygons.within(parts.unionByName(customers), plots, 2.0).select("kind", "k", "n_nationkey")


@query("p25_runoff", """WITH RECURSIVE c AS (SELECT p_partkey % 64 AS cx, p_partkey // 64 AS cy, p_size + 3 * (p_partkey // 64) AS h, CAST(round(p_retailprice * 100) AS BIGINT) AS rain FROM part),
n AS (SELECT a.cx, a.cy, b.cx AS tx, b.cy AS ty, row_number() OVER (PARTITION BY a.cx, a.cy ORDER BY (a.h - b.h) * (a.h - b.h) * CASE WHEN a.cx = b.cx OR a.cy = b.cy THEN 2 ELSE 1 END DESC, b.cy, b.cx) AS k
      FROM c a JOIN c b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND b.h < a.h),
w(ox, oy, rain, cx, cy) AS (SELECT cx, cy, rain, cx, cy FROM c UNION ALL SELECT ox, oy, rain, tx, ty FROM w JOIN n USING (cx, cy) WHERE k = 1)
SELECT cx, cy, count(*) AS cells, CAST(sum(rain) AS BIGINT) AS water FROM w GROUP BY 1, 2""", "P")
def runoff(spark, sf_dir):
    """Water that comes through each cell of an elevation grid when all of it runs down the steepest way; rounds are as the logarithm of the longest way."""
    k = F.col("p_partkey")
    grid = load(spark, sf_dir, "part").select((k % 64).alias("cx"), F.floor(k / 64).alias("cy"), (F.col("p_size") + 3 * F.floor(k / 64)).cast("long").alias("h"), F.round(F.col("p_retailprice") * 100).cast("long").alias("rain"))
    flow = graphs.steepest_descent(grid.select("cx", "cy", "h")).join(grid.select("cx", "cy", "rain"), ["cx", "cy"])
    name = lambda x, y: F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("cx"), F.col(y).alias("cy")))
    nodes = flow.select(name("cx", "cy").alias("cell"), name("to_x", "to_y").alias("to"), F.lit(1).cast("long").alias("cells"), F.col("rain").alias("water"))
    return graphs.upstream_sums(nodes, "cell", "to", ["cells", "water"]).select("cell.cx", "cell.cy", "cells", "water")


@query("p13_weighted_sample", """WITH z AS (SELECT p_type, count(*) * stddev_pop(p_retailprice) AS w FROM part GROUP BY 1), t AS (SELECT p_type, CAST(ceil(100 * w / sum(w) OVER ()) AS BIGINT) AS take FROM z),
r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY -ln((p_partkey % 2147483648 * 2654435761 % 4294967296 + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / p_size, p_partkey) AS n FROM part)
SELECT p_type, p_partkey FROM r JOIN t USING (p_type) WHERE n <= take""", "P")
def weighted_sample(spark, sf_dir):
    """About a hundred places, a zone's share by its rows and their deviation, and within it by size: exponential keys, of which the smallest stay."""
    part = load(spark, sf_dir, "part")
    z = part.groupBy("p_type").agg((F.count("*") * F.stddev_pop("p_retailprice")).alias("w"))
    share = z.select("p_type", F.ceil(100 * F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).alias("take"))
    # One row a zone, and as many zones as there are types of parts.
    rows = part.select("p_type", "p_partkey", "p_size").join(F.broadcast(share), "p_type")
    return estimates.weighted_sample(rows, "p_type", F.col("p_size"), "p_partkey", F.col("take"), 101).select("p_type", "p_partkey")


@query("p03_discriminant", """WITH g AS (SELECT p_type, count(*) AS n, avg(p_retailprice) AS mx, avg(p_size) AS my, var_pop(p_retailprice) AS vx, var_pop(p_size) AS vy, covar_pop(p_retailprice, p_size) AS vxy FROM part GROUP BY 1),
p AS (SELECT sum(n * vx) / (sum(n) - count(*)) AS sx, sum(n * vy) / (sum(n) - count(*)) AS sy, sum(n * vxy) / (sum(n) - count(*)) AS sxy, sum(n) AS total FROM g),
b AS (SELECT p_type, n, mx, my, ln(n / total) AS prior, (sy * mx - sxy * my) / (sx * sy - sxy * sxy) AS b1, (sx * my - sxy * mx) / (sx * sy - sxy * sxy) AS b2 FROM g, p)
SELECT p_type AS stress, n, round(prior - (b1 * mx + b2 * my) / 2, 5) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM b""", "P")
def discriminant(spark, sf_dir):
    """Kinds of stress told apart by a fitted linear discriminant of two indices."""
    b = estimates.discriminants(load(spark, sf_dir, "part"), "p_type", "p_retailprice", "p_size")
    return b.select(F.col("p_type").alias("stress"), "n", F.round("b0", 5).alias("b0"), F.round("b1", 6).alias("b1"), F.round("b2", 6).alias("b2"))


SECTION = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]*)', 1)"


@query("r19_reachable", f"""WITH RECURSIVE l AS ({LINKS_SQL}), edge AS (SELECT DISTINCT 'page ' || page_id AS src, href AS dst FROM l UNION SELECT {SECTION}, 'page ' || page_id FROM pages),
r(node) AS (SELECT {SECTION} FROM pages WHERE page_id = (SELECT min(page_id) FROM pages) UNION SELECT dst FROM r JOIN edge ON src = node) SELECT node FROM r""", "R")
def reachable_pages(spark, sf_dir):
    """What the first page's section leads to: from sections to their pages, and from pages by their links to targets, some of which are sections."""
    pages = load(spark, sf_dir, "pages")
    page = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    out = pages.select(page.alias("src"), F.explode(H.links(F.col("html"))).alias("dst"))
    section = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
    back = pages.select(section.alias("src"), page.alias("dst"))
    first = pages.groupBy().agg(F.min_by(section, "page_id").alias("node"))
    return graphs.reachable(out.unionByName(back), first).select("node")


@query("p37_micro_variability", f"""WITH {POINTS}, v AS (SELECT p_brand, floor(x / 10) AS cx, floor(y / 10) AS cy, count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM part JOIN points USING (p_partkey) GROUP BY 1, 2, 3),
z AS (SELECT p_brand, stddev_pop(p_retailprice) AS sd FROM part GROUP BY 1)
SELECT p_brand, count(*) AS cells, round(sqrt(sum(n * v) / sum(n)), 4) AS inside, round(any_value(sd), 4) AS whole, count(*) FILTER (WHERE n > 1 AND sqrt(v) > sd) AS rough FROM v JOIN z USING (p_brand) GROUP BY 1""", "P")
def micro_variability(spark, sf_dir):
    """How values vary within small cells of a plot, against the whole plot: moments of cells, which merge to those of the plot."""
    cell = lambda c: F.floor(F.col(c) / 10)
    cells = _placed(load(spark, sf_dir, "part"), "p_partkey").groupBy("p_brand", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("m"), F.var_pop("p_retailprice").alias("v"))
    n = F.col("n")
    sums = cells.groupBy("p_brand").agg(F.sum("n").alias("rows"), F.sum(n * F.col("m")).alias("first"), F.sum(n * F.col("v")).alias("within"), F.count("*").alias("cells"))
    middle = sums.withColumn("mean", F.col("first") / F.col("rows"))
    both = cells.join(F.broadcast(middle.select("p_brand", "mean")), "p_brand")  # a row a plot
    spread = both.groupBy("p_brand").agg(F.sum(n * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"))
    whole = middle.join(spread, "p_brand").withColumn("sd", F.sqrt((F.col("within") + F.col("between")) / F.col("rows")))
    rough = cells.join(F.broadcast(whole.select("p_brand", "sd")), "p_brand").groupBy("p_brand").agg(F.count(F.when((n > 1) & (F.sqrt("v") > F.col("sd")), 1)).alias("rough"))
    return whole.join(rough, "p_brand").select("p_brand", "cells", F.round(F.sqrt(F.col("within") / F.col("rows")), 4).alias("inside"), F.round("sd", 4).alias("whole"), "rough")


@query("p44_prescription_map", f"""WITH {POINTS}, {VERTICES}, o AS (SELECT c_custkey, c_acctbal AS v, {PLACE.format(k='c_custkey', x='ox', y='oy')} FROM customer),
d AS (SELECT p_partkey, c_custkey, v, (x - ox) * (x - ox) + (y - oy) * (y - oy) AS d2 FROM points, o), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d2, c_custkey) AS rank FROM d),
m AS (SELECT p_partkey, sum(v / (d2 + 1)) / sum(1 / (d2 + 1)) AS estimate FROM r WHERE rank <= 4 GROUP BY 1),
i AS (SELECT p_partkey, n_nationkey FROM points, e WHERE (ay > y) <> (ey > y) AND x < (ex - ax) * (y - ay) / (ey - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT n_nationkey, count(*) AS places, CAST(sum(round(greatest(0, 9000 - estimate) / 50)) AS BIGINT) AS dose FROM i JOIN m USING (p_partkey) GROUP BY 1""", "P")
def prescription_map(spark, sf_dir):
    """From samples to a map, from the map to doses, and from those, handed over as a committed table, to what each plot's machine loads."""
    root = bounded.new_root(spark)
    points = _placed(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    samples = _placed(load(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), "c_custkey", "ox", "oy")
    fertility = nearest.inverse_distance(nearest.k_nearest(points, samples, 4, "p_partkey", "c_custkey"), "p_partkey", "v")
    segments.append(fertility.select("p_partkey", F.round(F.greatest(F.lit(0.0), 9000 - F.col("estimate")) / 50).cast("long").alias("dose")), f"{root}/doses")
    plots = _plots(spark, sf_dir).select("n_nationkey", polygons.edges(polygons.rings(F.col("wkt"))).alias("edges"))
    inside = polygons.within(points, plots, 2.0).select("p_partkey", "n_nationkey")
    return segments.read(spark, f"{root}/doses").join(inside, "p_partkey").groupBy("n_nationkey").agg(F.count("*").alias("places"), F.sum("dose").alias("dose"))


@query("p49_geojson", f"""WITH {VERTICES}, r AS (SELECT n_nationkey, ring, abs(sum(ax * ey - ex * ay)) / 2 AS area FROM e GROUP BY 1, 2), s AS (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1)
SELECT n_nationkey, n_name AS name, coalesce(suppliers, 0) AS suppliers, balance, (SELECT sum(CASE ring WHEN 0 THEN area ELSE -area END) FROM r WHERE r.n_nationkey = nation.n_nationkey) AS area FROM nation LEFT JOIN s USING (n_nationkey)""", "P")
def geojson(spark, sf_dir):
    """Plots with what is known of them, exported as features of GeoJSON, a line each, and read back: geometry and properties alike."""
    about = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    rows = _plots(spark, sf_dir).join(load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name")), "n_nationkey").join(about, "n_nationkey", "left")
    rings = F.transform(polygons.rings(F.col("wkt")), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    properties = F.struct(F.col("n_nationkey"), F.col("name"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.col("balance"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    lines = round_trip(rows.select(F.to_json(feature).alias("value")), "text")
    kind = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<n_nationkey: int, name: string, suppliers: long, balance: double>"
    back = lines.select(F.from_json("value", kind).alias("f"))
    corners = F.transform(F.col("f.geometry.coordinates"), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return back.select("f.properties.*", polygons.area(corners).alias("area"))


@query("p50_rotation_plan", """WITH h AS (SELECT o_custkey, o_orderpriority AS crop, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders),
l AS (SELECT c_custkey, c_nationkey, max(crop) FILTER (WHERE back = 1) AS last, max(crop) FILTER (WHERE back = 2) AS earlier FROM customer LEFT JOIN h ON o_custkey = c_custkey GROUP BY 1, 2),
k AS (SELECT DISTINCT o_orderpriority AS crop FROM orders)
SELECT c_custkey, last, earlier, (SELECT min(crop) FROM k WHERE crop IS DISTINCT FROM last AND crop IS DISTINCT FROM earlier) AS next_crop, CASE WHEN r_name IN ('AFRICA', 'MIDDLE EAST') THEN 'drip' ELSE 'rain' END AS irrigation
FROM l JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""", "P")
def rotation_plan(spark, sf_dir):
    """The next crop of each plot: the first that it has not had in its last two seasons; and how its zone is watered."""
    orders = load(spark, sf_dir, "orders")
    season = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    # The group limit reaches below the shuffle: two rows a plot and partition are exchanged.
    two = orders.select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("crop")).withColumn("back", F.row_number().over(season)).where("back <= 2")
    had = two.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("back") == 1, F.col("crop"))).alias("last"), F.max(F.when(F.col("back") == 2, F.col("crop"))).alias("earlier"))
    crops = orders.select(F.col("o_orderpriority").alias("crop")).distinct().agg(F.array_sort(F.collect_set("crop")).alias("crops"))  # one row of the names of crops
    zones = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.when(F.col("r_name").isin("AFRICA", "MIDDLE EAST"), "drip").otherwise("rain").alias("irrigation"))
    plots = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(zones), F.col("n_nationkey") == F.col("c_nationkey")).join(had, "c_custkey", "left").withColumn("crops", crops.scalar())
    free = F.filter("crops", lambda c: ~c.eqNullSafe(F.col("last")) & ~c.eqNullSafe(F.col("earlier")))
    return plots.select("c_custkey", "last", "earlier", F.get(free, F.lit(0)).alias("next_crop"), "irrigation")


class Admission:
    """A table function over batches of one plant in order: which are let in, by what stands in it.

    A batch stands for so many days; it is let in if it isn't too small and stays, with what
    stands, within the plant's limit. No more than limit / least batches stand at once.
    """

    def __init__(self):
        self.standing: list[tuple[datetime.date, int]] = []

    @staticmethod
    def analyze(rows: AnalyzeArgument, days: AnalyzeArgument, least: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"plant", "batch", "day", "litres"} <= set(rows.dataType.fieldNames()):
            raise ValueError("a table of plant, batch, day and litres is needed")
        if not all(a.isConstantExpression for a in (days, least, limit)):
            raise ValueError("days, least and limit are constants")
        schema = StructType()
        for name in ("plant", "batch", "litres", "standing"):
            schema = schema.add(name, "long")
        return AnalyzeResult(schema.add("accepted", "boolean"))

    def eval(self, row, days: int, least: int, limit: int):
        self.standing = [s for s in self.standing if s[0] > row["day"]]
        stands = sum(n for _, n in self.standing)
        accepted = least <= row["litres"] <= limit - stands
        if accepted:
            self.standing.append((row["day"] + datetime.timedelta(days=days), row["litres"]))
        yield row["plant"], row["batch"], row["litres"], stands, accepted


@query("p42_admission", """WITH RECURSIVE b AS (SELECT o_custkey AS plant, o_orderkey AS batch, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice / 50) AS BIGINT) AS litres, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
r(plant, i, batch, litres, standing, accepted, held) AS (
  SELECT DISTINCT plant, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST([] AS STRUCT(d DATE, l BIGINT)[]) FROM b
  UNION ALL SELECT plant, i, batch, litres, s, ok, CASE WHEN ok THEN list_append(held, {'d': CAST(day + 180 AS DATE), 'l': litres}) ELSE held END FROM (
    SELECT *, litres >= 1000 AND litres <= 6000 - s AS ok FROM (
      SELECT *, CAST(coalesce(list_sum(list_transform(held, lambda x: x.l)), 0) AS BIGINT) AS s FROM (
        SELECT b.plant, b.i, b.batch, b.litres, b.day, list_filter(r.held, lambda x: x.d > b.day) AS held FROM r JOIN b ON b.plant = r.plant AND b.i = r.i + 1))))
SELECT plant, batch, litres, standing, accepted FROM r WHERE i > 0""", "P")
def admission(spark, sf_dir):
    """Batches let into plants in the order in which they come: a thousand litres at least, six thousand at once, each for half a year."""
    spark.udtf.register("admit", F.udtf(Admission))
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plant"), F.col("o_orderkey").alias("batch"), F.to_date("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") / 50).alias("litres"))
    rows.createOrReplaceTempView("batches")
    return spark.sql("SELECT * FROM admit(TABLE(batches) PARTITION BY plant ORDER BY (day, batch), 180, 1000, 6000)")
