"""Streams to the end of their windows, state with timers, and the segment table's offsets and commits."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from sluice.sources import segments
from sluice.streaming import bounded, stateful

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def table(spark, tmp_path, rows):
    """A folder with rows as its events table."""
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    return f"file://{tmp_path}"


def at(day, hour, minute=0):
    return f"2024-03-{day:02d} {hour:02d}:{minute:02d}:00"


def test_silent_zone_is_given_out_by_its_timer_and_its_state_goes(spark, tmp_path):
    """Zone 1 falls silent in the first delivery; nothing of it comes later, so only a timer can close it."""
    rows = [(i, at(1, i), 1, "a", float(i)) for i in range(3)] + [(10 + d, at(d, 12), 2, "b", 1.0) for d in range(1, 13)]
    progress = []

    def plan(e):
        hours = e.groupBy(F.window("ts", "1 hour"), "user_id", "event_type").agg(F.avg("value").alias("mean"))
        hours = hours.select(F.col("user_id").alias("zone"), F.col("event_type").alias("depth"), F.window_time("window").alias("at"), F.col("window.start").alias("hour"), "mean")
        return stateful.moisture_spells(hours, 24)

    sf = table(spark, tmp_path, rows)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    out = bounded.run_to_end(spark, sf, "events", "ts", "event_type", plan, "1 hour", 3, conf=stateful.ROCKSDB, progress=progress)
    got = {(r.zone, r.depth): (r.hours, r.mean, r["last"], str(r.started), str(r.ended)) for r in out.collect()}
    assert got == {(1, "a"): (3, 1.0, 2.0, at(1, 0), at(1, 2)), (2, "b"): (12, 1.0, 1.0, at(1, 12), at(12, 12))}
    held = [o.numRowsTotal for p in progress for o in p.stateOperators if o.operatorName.startswith("transformWithState")]
    assert max(held) > 0 and held[-1] == 0
    # Zone 1 is gone before the last delivery: its rows are in an earlier batch than zone 2's.
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_appended_windows_come_out_once_and_hold_no_state(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, at(rng.randint(1, 9), rng.randint(0, 23), rng.randint(0, 59)), rng.randint(1, 5), rng.choice("ab"), float(i)) for i in range(300)]
    progress = []

    def plan(e):
        hours = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
        at_ = hours.select(F.window_time("window").alias("at"), "n")
        return at_.groupBy(F.window("at", "1 day")).agg(F.sum("n").alias("n"), F.count("*").alias("hours"))

    out = bounded.run_to_end(spark, table(spark, tmp_path, rows), "events", "ts", "event_type", plan, "1 hour", 3, progress=progress)
    got = {str(r.window.start)[:10]: (r.n, r.hours) for r in out.collect()}
    days = {f"2024-03-{d:02d}" for d in range(1, 10)}
    want = {d: (sum(r[1].startswith(d) for r in rows), len({(r[1][:13], r[3]) for r in rows if r[1].startswith(d)})) for d in days}
    assert got == want and out.count() == len(want)
    # Days are appended by the deliveries that end them, not all at the end.
    assert sum(p.numInputRows > 0 for p in progress) >= 4 and sum(o.numRowsRemoved for p in progress[:-2] for o in p.stateOperators) > 0


def test_unmatched_rows_of_an_outer_join_come_out_once(spark, tmp_path):
    rows = [(1, at(1, 0), 1, "view", 0.0), (2, at(1, 3), 1, "purchase", 0.0), (3, at(1, 5), 2, "view", 0.0), (4, at(1, 20), 2, "purchase", 0.0), (5, at(9, 0), 1, "view", 0.0)]

    def plan(e):
        v = e.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("event_id").alias("view"), F.col("ts").alias("a"))
        p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "ts")
        return v.join(p, F.expr("u = user_id AND ts >= a AND ts <= a + INTERVAL 6 HOURS"), "left").select("view", "purchase")

    out = bounded.run_to_end(spark, table(spark, tmp_path, rows), "events", "ts", "event_type", plan, "1 hour", 2)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2), (3, None), (5, None)]


def test_an_empty_table_ends(spark, tmp_path):
    plan = lambda e: e.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    assert bounded.run_to_end(spark, table(spark, tmp_path, []), "events", "ts", "event_type", plan, "1 hour", 2).count() == 0


def test_a_stopped_stream_neither_loses_nor_repeats(spark, tmp_path):
    path, root = f"file://{tmp_path}/log", f"file://{tmp_path}/run"
    frame = lambda a, b: spark.range(a, b).selectExpr("id", "id * 2 AS x").repartition(3)
    segments.append(frame(0, 100), path)
    segments.append(frame(100, 120), path)
    assert bounded.run(segments.stream(spark, path), "append", root).count() == 120
    assert bounded.run(segments.stream(spark, path), "append", root).count() == 120
    segments.append(frame(120, 130), path)
    got = bounded.run(segments.stream(spark, path), "append", root)
    assert sorted(r.id for r in got.collect()) == list(range(130))


def test_a_batch_that_fails_is_read_again_whole(spark, tmp_path):
    """The first run dies after it has planned a batch and before it has committed it; the next one reads the same offsets."""
    path, root = f"file://{tmp_path}/log", f"file://{tmp_path}/run"
    segments.append(spark.range(50).repartition(2), path)

    def die(batch, number):
        batch.count()
        raise RuntimeError("stopped here")

    q = segments.stream(spark, path).writeStream.foreachBatch(die).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="stopped here"):
        q.awaitTermination()
    segments.append(spark.range(50, 60), path)
    got = bounded.run(segments.stream(spark, path), "append", root)
    assert sorted(r.id for r in got.collect())[:50] == list(range(50))
    got = bounded.run(segments.stream(spark, path), "append", root)  # if the run before ended with the batch that it had to repeat
    assert sorted(r.id for r in got.collect()) == list(range(60))


def test_a_failed_write_leaves_nothing_to_be_seen(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    segments.append(spark.range(10), path)
    bad = spark.range(1000).repartition(4).withColumn("id", F.when(F.col("id") == 777, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="no"):
        segments.append(bad, path)
    assert sorted(r.id for r in segments.read(spark, path).collect()) == list(range(10))
    assert len(glob.glob(f"{tmp_path}/table/commits/*.json")) == 1
    segments.append(spark.range(5), path, overwrite=True)
    assert segments.read(spark, path).count() == 5 and segments.read(spark, path).schema == spark.range(1).schema


def test_two_writers_cannot_make_one_commit(tmp_path):
    folder = segments.Folder(f"file://{tmp_path}/t")
    folder.commit(["a"], False, "{}")
    folder.count = lambda: 0
    with pytest.raises(RuntimeError, match="another writer"):
        folder.commit(["b"], False, "{}")
    assert [m["files"] for m in segments.Folder(f"file://{tmp_path}/t").manifests()] == [["a"]]
    assert not any(n.startswith(".") for n in os.listdir(f"{tmp_path}/t/commits"))


def test_empty_writes_and_missing_tables(spark, tmp_path):
    with pytest.raises(Exception, match="nothing has been committed"):
        segments.read(spark, f"file://{tmp_path}/none").collect()
    segments.append(spark.range(0), f"file://{tmp_path}/t")
    assert segments.read(spark, f"file://{tmp_path}/t").count() == 0


def test_state_by_day_equals_a_loop(spark, tmp_path):
    """Two batches, the second of which goes on within a day of the first."""
    rng = random.Random(21)
    rows = sorted((at(rng.randint(1, 5), rng.randint(0, 23), rng.randint(0, 59)), i, rng.randint(1, 4), rng.choice(["toggle", "toggle", "reset", "other"])) for i in range(200))
    rows = [r for r in rows if not (r[2] == 4 and r[3] == "reset")]
    want = {}
    for _, _, u, kind in rows:
        seen, is_open = want.get(u, (0, False))
        want[u] = seen + 1, False if kind == "reset" else is_open != (kind == "toggle")
    root = f"file://{tmp_path}/run"
    cut = next(i for i, r in enumerate(rows) if r[0] >= at(3, 11))
    for part in (rows[:cut], rows[cut:]):
        spark.createDataFrame(part, "ts string, event_id long, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("ts timestamp, event_id long, user_id long, event_type string").parquet(f"file://{tmp_path}/in")
        out = bounded.run(stateful.open_state_by_day(stream, "toggle", "reset"), "update", root)
    assert {r.user_id: (r.seen, r.is_open) for r in stateful.combine_days(out).collect()} == want
