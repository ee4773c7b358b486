"""Zones that share a bucket: their spells equal a loop over hours, and their state is a row a bucket, with its timer."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sluice.streaming import bounded, stateful


def test_zones_of_a_bucket_keep_their_own_spells(spark, tmp_path):
    rng, start = random.Random(14), datetime(2024, 3, 1)
    rows = [(i, start + timedelta(hours=rng.randint(0, 600)), rng.randint(1, 12), rng.choice("ab"), rng.choice([float(i), float(-i), None])) for i in range(300)]
    cells = defaultdict(list)
    for _, t, zone, depth, v in rows:
        cells[zone, t, depth] += [v] if v is not None else []
    spells = defaultdict(list)
    for zone in range(1, 13):
        hours = sorted({t for z, t, _ in cells if z == zone})
        for t in hours:
            if not spells[zone] or t - spells[zone][-1][-1] > timedelta(hours=24):
                spells[zone].append([])
            spells[zone][-1].append(t)
    want = set()
    for zone, own in spells.items():
        for spell in own:
            for depth in "ab":
                means = [(sum(v) / len(v) if (v := cells[zone, t, depth]) else None) for t in spell if (zone, t, depth) in cells]
                there = [m for m in means if m is not None]
                if means:
                    want.add((zone, depth, spell[0], spell[-1], len(means), round(sum(there) / len(there), 6) if there else None, round(there[-1], 6) if there else None))
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    progress = []

    def plan(e):
        hours = e.groupBy(F.window("ts", "1 hour"), "user_id", "event_type").agg(F.avg("value").alias("mean"))
        hours = hours.select(F.col("user_id").alias("zone"), F.col("event_type").alias("depth"), F.window_time("window").alias("at"), F.col("window.start").alias("hour"), "mean")
        return stateful.moisture_spells(hours, 24, buckets=2)

    out = bounded.run_to_end(spark, f"file://{tmp_path}", "events", "ts", "event_type", plan, "1 hour", 3, conf=stateful.ROCKSDB, progress=progress)
    rounded = lambda v: None if v is None else round(v, 6)
    got = [(r.zone, r.depth, r.started, r.ended, r.hours, rounded(r["mean"]), rounded(r["last"])) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    held = [o.numRowsTotal for p in progress for o in p.stateOperators if o.operatorName.startswith("transformWithState")]
    # A bucket has its value, its timer, and the timer's two entries.
    assert 0 < max(held) <= 2 * 4 and held[-1] == 0
