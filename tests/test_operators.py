import random

from pyspark.sql import functions as F

from sluice.operators import folds, joins, ranking, zones
from sluice.sources.tables import read_html
from sluice.streaming import bounded, stateful


def events(n=400, seed=5):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 1, 2, 3, None]), f"2024-01-{rng.randint(1, 9):02d} {rng.randint(0, 23):02d}:00:00", rng.choice(["toggle", "reset", "other"]), float(rng.randint(0, 99))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_reset_fold_equals_a_loop(spark):
    rows = [r for r in events() if r[1] is not None]
    want, state = {}, {}
    for i, u, t, kind, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        state[u] = False if kind == "reset" else state.get(u, False) != (kind == "toggle")
        want[i] = state[u]
    out = folds.toggle_with_reset(frame(spark, rows), "user_id", ("ts", "event_id"), F.col("event_type") == "toggle", F.col("event_type") == "reset")
    assert {r.event_id: r.is_open for r in out.collect()} == want
    parity, n = {}, {}
    for i, u, t, kind, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        n[u] = n.get(u, 0) + (kind == "toggle")
        parity[i] = n[u] % 2 == 1
    out = folds.toggle_parity(frame(spark, rows), "user_id", ("ts", "event_id"), F.col("event_type") == "toggle")
    assert {r.event_id: r.is_open for r in out.collect()} == parity


def test_asof_join_equals_a_loop(spark):
    rows = [r for r in events(600) if r[1] is not None]
    left, right = [r for r in rows if r[3] == "toggle"], [r for r in rows if r[3] == "other"]
    want = {}
    for i, u, t, _, _ in left:
        before = [(x[2], x[0], x[4]) for x in right if x[1] == u and x[2] <= t]
        want[i] = max(before)[2] if before else None
    df = frame(spark, rows)
    out = joins.asof_join(df.where("event_type = 'toggle'").select("event_id", "user_id", "ts"), df.where("event_type = 'other'"), "user_id", "ts", "ts", "value", "event_id")
    assert {r.event_id: r.matched for r in out.collect()} == want


def test_range_join_repeats_no_pair(spark):
    p = spark.createDataFrame([(float(x),) for x in range(-20, 40)], "x double")
    r = spark.createDataFrame([("a", -15.0, 7.0), ("b", 5.0, 5.5), ("c", 0.0, 39.0)], "name string, lo double, hi double")
    got = sorted((x.x, x.name) for x in joins.range_join(p, r, "x", "lo", "hi", 10.0).collect())
    assert got == sorted((float(x), n) for x in range(-20, 40) for n, lo, hi in (("a", -15, 7), ("b", 5, 5.5), ("c", 0, 39)) if lo <= x < hi)


def test_cascade_prefers_specific_then_late(spark):
    rules = spark.createDataFrame([("e", 1, 5, "late"), ("e", 2, 1, "specific"), ("f", 1, 1, "a"), ("f", 1, 2, "b")], "element string, spec int, pos int, rule string")
    assert {r.element: r.rule for r in ranking.cascade(rules, "element", "spec", "pos").collect()} == {"e": "specific", "f": "b"}


def test_zones_and_area(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "k long, v double")
    counts = {r.zone: r["count"] for r in zones.zones_by_share(df, "v", 1.0, {"A": 0.35, "B": 0.5, "C": 0.15}).groupBy("zone").count().collect()}
    assert counts == {"A": 35, "B": 50, "C": 15}
    tri = spark.range(1).select(zones.polygon_area(F.array(F.lit(0.0), F.lit(4.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(3.0))).alias("a"))
    assert tri.first().a == 6.0


def test_html_files_are_read_whole(spark, tmp_path):
    (tmp_path / "one.html").write_text("<p>a\nb</p>")
    assert [tuple(r) for r in read_html(spark, f"file://{tmp_path}").collect()] == [("one", "<p>a\nb</p>")]


def test_state_lasts_over_batches(spark, tmp_path):
    """Two files give two batches; the second goes on from the first."""
    rows = [(1, 7, "2024-01-01 00:00:00", "toggle", 0.0), (2, 7, "2024-01-01 01:00:00", "toggle", 0.0), (3, 7, "2024-01-01 02:00:00", "toggle", 0.0), (4, 8, "2024-01-01 02:00:00", "toggle", 0.0), (5, 8, "2024-01-02 02:00:00", "reset", 0.0)]
    path = f"file://{tmp_path}/events.parquet"
    frame(spark, rows[:2]).coalesce(1).write.parquet(path)
    frame(spark, rows[2:]).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    out = folds.latest_per_key(bounded.run(stateful.open_state(src, "toggle", "reset"), "update"), "user_id", "seen")
    assert {r.user_id: (r.seen, r.is_open) for r in out.collect()} == {7: (3, True), 8: (2, False)}


def test_neighbours_equal_a_loop(spark):
    rows = [r for r in events(500, 11) if r[1] is not None]
    series = {}
    for i, u, t, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        series.setdefault(u, []).append((i, v))
    want = {}
    for own in series.values():
        for k, (i, _) in enumerate(own):
            want[i] = ([v for _, v in own[max(0, k - 3) : k]], [v for _, v in own[k + 1 : k + 3]], k + 1)
    out = folds.with_neighbours(frame(spark, rows), "user_id", ("ts", "event_id"), "value", 3, 2)
    assert {r.event_id: ([x.v for x in r._before], [x.v for x in r._after], r._rank) for r in out.collect()} == want
    mean = folds.running_mean_before(frame(spark, rows), "user_id", ("ts", "event_id"), "value", "m")
    assert all((r.m is None) == (want[r.event_id][2] == 1) for r in mean.collect())


def test_spatial_joins_equal_all_pairs(spark):
    rng = random.Random(4)
    places = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(120)]
    boxes = [(i, x, y, x + rng.uniform(1, 12), y + rng.uniform(1, 12)) for i, x, y in places[:30]]
    p = spark.createDataFrame(places, "k long, x double, y double")
    got = zones.within_boxes(p, spark.createDataFrame(boxes, "b long, x0 double, y0 double, x1 double, y1 double"), 5.0)
    assert sorted((r.k, r.b) for r in got.collect()) == sorted((k, b) for k, x, y in places for b, x0, y0, x1, y1 in boxes if x0 <= x < x1 and y0 <= y < y1)
    near = zones.nearby(p, p.toDF("o", "ox", "oy"), 4.0)
    assert sorted((r.k, r.o) for r in near.collect()) == sorted((a, b) for a, x, y in places for b, u, v in places if (x - u) ** 2 + (y - v) ** 2 <= 16)


def test_budget_is_spent_on_the_best(spark):
    rng = random.Random(8)
    rows = [(i, float(rng.randint(0, 60)), rng.randint(1, 9)) for i in range(200)]
    want, spent = set(), 0
    for i, _, c in sorted(rows, key=lambda r: (-r[1], r[0])):
        spent += c
        if spent <= 333:
            want.add((i, spent))
    got = zones.take_until(spark.createDataFrame(rows, "k long, v double, c long"), "v", "c", "k", 333, 7)
    assert {(r.k, r.spent) for r in got.collect()} == want
