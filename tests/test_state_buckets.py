"""Keyed state in buckets: as many state rows as buckets, and the same results as a loop over events."""

import random

from pyspark.sql import functions as F

from sluice.streaming import bounded, stateful


def test_days_share_buckets_over_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted((f"2024-03-{rng.randint(1, 6):02d} {rng.randint(0, 23):02d}:00:00", i, rng.choice([*range(40), None]), rng.choice(["toggle", "toggle", "reset", "other", None])) for i in range(900))
    want = {}
    for _, _, u, kind in rows:
        if u is not None:
            seen, is_open = want.get(u, (0, False))
            want[u] = seen + 1, False if kind == "reset" else is_open != (kind == "toggle")
    progress, schema = [], "ts string, event_id long, user_id long, event_type string"
    for cut in (slice(0, 300), slice(300, 301), slice(301, 900)):
        spark.createDataFrame(rows[cut], schema).withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema.replace("ts string", "ts timestamp")).parquet(f"file://{tmp_path}/in")
        out = bounded.run(stateful.open_state_by_day(stream, "toggle", "reset", buckets=3), "update", f"file://{tmp_path}/run", progress=progress)
    assert {r.user_id: (r.seen, r.is_open) for r in stateful.combine_days(out).collect()} == want
    assert max(o.numRowsTotal for p in progress for o in p.stateOperators) == 3
