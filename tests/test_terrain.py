"""Nearest samples, polygons, sums down pointers, weighted samples and admission, against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import sluice.plans  # noqa: F401
from sluice.operators import estimates, graphs, nearest, polygons
from sluice.registry import ENTRIES


def near(points, samples, k):
    out = set()
    for i, x, y in points:
        order = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in samples)
        out |= {(i, j, d, r + 1) for r, (d, j) in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("kind", ["even", "clustered", "few", "line", "same"])
def test_nearest_are_exact(spark, kind):
    rng = random.Random(kind)
    spot = {"even": lambda: (rng.uniform(0, 50), rng.uniform(0, 80)), "clustered": lambda: rng.choice([(rng.gauss(5, 0.01), rng.gauss(5, 0.01)), (rng.uniform(0, 100), rng.uniform(0, 100))]), "few": lambda: (rng.random(), rng.random()), "line": lambda: (rng.uniform(0, 100), 3.0), "same": lambda: (7.0, float(rng.randint(0, 1)))}[kind]
    samples = [(j, *spot()) for j in range(3 if kind == "few" else 500)]
    points = [(i, rng.uniform(-5, 105), rng.uniform(-5, 105)) for i in range(60)] + [(100 + i, *spot()) for i in range(60)]
    p = spark.createDataFrame([*points, (999, None, 1.0)], "i long, x double, y double")
    s = spark.createDataFrame([*samples, (-1, None, None)], "j long, ox double, oy double").withColumn("v", F.col("j") * 2.0)
    got = nearest.k_nearest(p, s, 5, "i", "j")
    assert {(r.i, r.j, r.d2, r["rank"]) for r in got.collect()} == near(points, samples, 5)
    one = nearest.inverse_distance(got, "i", "v").where("i = 3").first()
    w = [(j * 2.0, 1 / (d + 1)) for i, j, d, _ in near(points, samples, 5) if i == 3]
    assert one.n == len(w) and math.isclose(one.estimate, sum(v * x for v, x in w) / sum(x for _, x in w), rel_tol=1e-12)


def test_nearest_of_nothing(spark):
    p, s = "i long, x double, y double", "j long, ox double, oy double"
    assert nearest.k_nearest(spark.createDataFrame([], p), spark.createDataFrame([(1, 0.0, 0.0)], s), 2, "i", "j").count() == 0
    assert nearest.k_nearest(spark.createDataFrame([(1, 0.0, 0.0)], p), spark.createDataFrame([], s), 2, "i", "j").count() == 0


def star(rng, cx, cy, size, n):
    """A closed ring around a centre whose radius jumps, so that it is anything but convex."""
    ring = [(cx + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*ring, ring[0]]


def inside(ring, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2 == 1


def test_points_in_polygons_equal_ray_casts(spark):
    rng = random.Random(6)
    shapes = []
    for k in range(12):
        cx, cy, size = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(1, 15)
        shapes.append((k, [star(rng, cx, cy, size, rng.randint(3, 40)), star(rng, cx, cy, size * 0.25, 5)]))
    text = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")"
    df = spark.createDataFrame([(k, f"POLYGON ({', '.join(text(r) for r in rings)})") for k, rings in shapes], "k long, wkt string")
    df = df.withColumn("rings", polygons.rings(F.col("wkt"))).withColumn("edges", polygons.edges(F.col("rings")))
    points = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(1500)]
    want = {(i, k) for i, x, y in points for k, rings in shapes if sum(inside(r, x, y) for r in rings) % 2 == 1}
    for cell in (0.7, 5.0, 100.0):
        got = polygons.within(spark.createDataFrame(points, "i long, x double, y double"), df.select("k", "edges"), cell)
        assert {(r.i, r.k) for r in got.collect()} == want
    cells = polygons.covering_cells(df.select("k", "edges"), 0.7)
    assert cells.where("near IS NULL").count() > 0 and cells.agg(F.max(F.size("near"))).first()[0] < max(sum(len(r) - 1 for r in rings) for _, rings in shapes)
    shoelace = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
    for r in df.select("k", polygons.area(F.col("rings")).alias("a"), polygons.perimeter(F.col("edges")).alias("p")).collect():
        rings = shapes[r.k][1]
        assert math.isclose(r.a, shoelace(rings[0]) - shoelace(rings[1]), rel_tol=1e-9)
        assert math.isclose(r.p, sum(math.dist(a, b) for ring in rings for a, b in zip(ring, ring[1:])), rel_tol=1e-9)


def test_open_rings_are_closed_and_odd_text_has_none(spark):
    df = spark.createDataFrame([("POLYGON((0 0,4 0,0 3))",), ("POLYGON EMPTY",), (None,)], "t string").withColumn("r", polygons.rings(F.col("t")))
    rows = df.select(polygons.area(F.col("r")).alias("a"), F.size(polygons.edges(F.col("r"))).alias("n")).collect()
    assert (rows[0].a, rows[0].n) == (6.0, 3) and rows[1].n == 0
    assert polygons.within(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), df.withColumn("edges", polygons.edges(F.col("r"))).select("t", "edges"), 1.0).count() == 1


def test_sums_down_pointers(spark):
    rng = random.Random(9)
    nodes = [(i, rng.randrange(i) if i and rng.random() < 0.95 else None, i % 7) for i in range(300)] + [(1000 + i, 1000 + i - 1 if i else None, 1) for i in range(70)]
    to = {i: t for i, t, _ in nodes}
    want = Counter()
    for i, _, v in nodes:
        at = i
        while at is not None:
            want[at] += v
            at = to[at]
    got = graphs.upstream_sums(spark.createDataFrame(nodes, "i long, t long, v long"), "i", "t", ["v"])
    assert {r.i: r.v for r in got.collect()} == {i: want[i] for i in to}


def test_reach_equals_breadth_first(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(100, 101), (None, 3), (5, None)]
    want, frontier = {0: 0}, [0]
    while frontier:
        frontier = [b for a, b in edges if a in frontier and b is not None and b not in want]
        want |= {b: max(want.values()) + 1 for b in frontier}
    start = spark.createDataFrame([(0,)], "node long")
    got = graphs.reachable(spark.createDataFrame(edges, "src long, dst long"), start)
    assert {r.node: r.hops for r in got.collect()} == want and got.count() == len(want)
    assert graphs.reachable(spark.createDataFrame([], "src long, dst long"), start.limit(0)).count() == 0


def test_water_runs_down_the_steepest_way(spark):
    rng = random.Random(12)
    h = {(x, y): rng.randint(0, 9) for x in range(12) for y in range(9) if rng.random() < 0.9}
    got = {(r.cx, r.cy): None if r.to_x is None else (r.to_x, r.to_y) for r in graphs.steepest_descent(spark.createDataFrame([(x, y, v) for (x, y), v in h.items()], "cx long, cy long, h long")).collect()}
    for (x, y), v in h.items():
        low = [(-(v - h[n]) ** 2 * (2 if dx == 0 or dy == 0 else 1), n[1], n[0]) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (n := (x + dx, y + dy)) in h and h[n] < v]
        assert got[x, y] == ((min(low)[2], min(low)[1]) if low else None)


def test_weighted_samples_have_their_size_and_follow_weights(spark):
    rows = spark.range(40000).select(F.col("id"), (F.col("id") % 400).alias("zone"), F.when(F.col("id") % 4000 < 400, 0).when(F.col("id") % 8000 < 4000, 1).otherwise(3).alias("w"))
    take = F.when(F.col("zone") < 100, 5).otherwise(20)
    got = estimates.weighted_sample(rows, "zone", F.col("w"), "id", take, 20)
    per = {r.zone: r["count"] for r in got.groupBy("zone").count().collect()}
    assert per == {z: 5 if z < 100 else 20 for z in range(400)}
    by = {r.w: r["count"] for r in got.groupBy("w").count().collect()}
    # Of 100 rows a zone, 45 have weight 1, 45 weight 3 and 10 none.
    have = {1: 18000, 3: 18000}
    assert 0 not in by and 2.2 < (by[3] / have[3]) / (by[1] / have[1]) < 3.0
    assert got.repartition(7).count() == got.count() and {r.id for r in estimates.weighted_sample(rows.repartition(9), "zone", F.col("w"), "id", take, 20).collect()} == {r.id for r in got.collect()}


def test_discriminant_tells_labels_apart(spark):
    rng = random.Random(13)
    rows = [(k, rng.gauss(3 * k, 1), rng.gauss(-2 * k, 1)) for k in (0, 1, 2) for _ in range(300)] + [(None, 1.0, 1.0), (1, None, 0.0)]
    b = {r.k: r for r in estimates.discriminants(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y").collect()}
    right = sum(max(b, key=lambda j: b[j].b0 + b[j].b1 * x + b[j].b2 * y) == k for k, x, y in rows[:900])
    assert sorted(b) == [0, 1, 2] and b[1].n == 300 and right > 0.9 * 900


def test_no_plant_stands_over_its_limit(spark):
    for r in ENTRIES["p42_admission"].run(spark, "/root/testdata/sf0.01").collect():
        assert r.accepted == (r.litres >= 1000 and r.standing + r.litres <= 6000)
        assert r.standing <= 6000
    with pytest.raises(Exception, match="a table of plant"):
        spark.sql("SELECT * FROM admit(TABLE(SELECT 1L AS plant), 180, 1000, 6000)").collect()


def test_nearest_work_grows_with_the_data(spark):
    """Candidates a point stay as many when there are ten times the samples."""
    def candidates(sf):
        seen = []
        real = nearest.written
        nearest.written = lambda df, name: seen.append((name, out := real(df, name))) or out
        try:
            ENTRIES["p15_nearest"].run(spark, f"/root/testdata/{sf}").count()
        finally:
            nearest.written = real
        return {name: df.count() for name, df in seen}

    small, large = candidates("sf0.001"), candidates("sf0.01")
    assert large["near"] < 12 * small["near"] and large["looking"] == 10 * small["looking"]
