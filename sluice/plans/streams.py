"""Streaming queries, run over a bounded input; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.registry import query
from sluice.streaming import bounded, stateful

#: Longer than the input's span, so that no row is late.
DELAY = "60 days"


def _events(spark, sf_dir):
    return bounded.stream(spark, sf_dir, "events", "ts").withWatermark("ts", DELAY)


def _appended(spark, sf_dir, plan, delay=DELAY, deliveries=1, **more):
    """What a plan over the events appends, to the end of all windows."""
    return bounded.run_to_end(spark, sf_dir, "events", "ts", "event_type", plan, delay, deliveries, **more)


def _buckets(spark, sf_dir, rows=20_000):
    """Buckets of about so many events, 64 at least."""
    return max(64, spark.read.parquet(f"{sf_dir}/events.parquet").count() // rows)


def _plain(c):
    return c.cast("timestamp_ntz")


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Counts by hour; an hour is appended once, and its state dropped, when the watermark has passed it."""
    out = _appended(spark, sf_dir, lambda e: e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")))
    return out.select(_plain(F.col("window.start")).alias("started"), "event_type", "n")


@query("stream_sliding", """SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS started, count(*) AS n FROM events, (VALUES (0), (1)) AS s(k) GROUP BY 1""")
def stream_sliding(spark, sf_dir):
    """Counts of overlapping half days, appended when they are over."""
    out = _appended(spark, sf_dir, lambda e: e.groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("n")))
    return out.select(_plain(F.col("window.start")).alias("started"), "n")


@query("stream_session", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_session(spark, sf_dir):
    """Sessions, appended when the watermark says that nothing can lengthen them."""
    out = _appended(spark, sf_dir, lambda e: e.groupBy(F.session_window("ts", "12 hours"), "user_id").agg(F.count("*").alias("n")))
    return out.select("user_id", _plain(F.col("session_window.start")).alias("started"), "n")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """Keys once each, within the watermark."""
    return bounded.run(_events(spark, sf_dir).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query("stream_join", "SELECT a.event_id AS view, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR")
def stream_join(spark, sf_dir):
    """Views with the same user's purchases in the six hours after them, of two streams."""
    e = _events(spark, sf_dir)
    v = e.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("event_id").alias("view"), F.col("ts").alias("at"))
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "ts")
    return bounded.run(v.join(p, F.expr("u = user_id AND ts >= at AND ts <= at + INTERVAL 6 HOURS")).select("view", "purchase"), "append")


@query("stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id")
def stream_static_join(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return bounded.run(_events(spark, sf_dir).join(customers, F.col("c_custkey") == F.col("user_id")).select("event_id", "c_mktsegment"), "append")


@query("stream_state", """WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM events), m AS (SELECT user_id, max(era) AS era, count(*) AS seen FROM g GROUP BY 1)
SELECT g.user_id, any_value(seen) AS seen, count(*) FILTER (WHERE event_type = 'click') % 2 = 1 AS is_open FROM g JOIN m ON g.user_id = m.user_id AND g.era = m.era GROUP BY 1""")
def stream_state(spark, sf_dir):
    """The reset fold as a stateful operator over users and days, in as many buckets as the table asks for; the days' last states give each user's."""
    buckets = _buckets(spark, sf_dir)
    out = bounded.run(stateful.open_state_by_day(_events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type"), "click", "error", buckets), "update")
    return stateful.combine_days(out)


@query("stream_rate_of_hours", "SELECT date_trunc('day', ts) AS day, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_daily_mean(spark, sf_dir):
    """Daily means, each appended when its day is over."""
    out = _appended(spark, sf_dir, lambda e: e.groupBy(F.window("ts", "1 day")).agg(F.avg("value").alias("m")))
    return out.select(_plain(F.col("window.start")).alias("day"), F.round("m", 6).alias("mean"))


@query("stream_late_rows", """WITH m AS (SELECT max(ts) - INTERVAL 5 DAY AS mark FROM events WHERE event_id % 2 = 0),
k AS (SELECT date_trunc('day', ts) AS day FROM events, m WHERE event_id % 2 = 0 OR date_trunc('day', ts) + INTERVAL 1 DAY > mark)
SELECT day, count(*) AS n FROM k GROUP BY 1""")
def stream_late_rows(spark, sf_dir):
    """Daily counts of two deliveries: of the second, days that ended before the watermark of the first are too late, and are dropped."""
    root = bounded.new_root(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{root}/in")
        arrived = spark.readStream.schema(events.schema).parquet(f"{root}/in").withWatermark("ts", "5 days")
        counts = bounded.run(arrived.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")), "update", root)
    # Of each day the last update, which is the largest.
    return counts.groupBy(_plain(F.col("window.start")).alias("day")).agg(F.max("n").alias("n"))


@query("stream_chained_windows", """WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT date_trunc('day', hour) AS day, event_type, count(*) AS hours, round(avg(m), 6) AS mean FROM h GROUP BY 1, 2""")
def stream_chained_windows(spark, sf_dir):
    """Daily means of hourly means: two stateful aggregations in one append query, in three deliveries."""

    def plan(e):
        hours = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.avg("value").alias("m"))
        at = hours.select(F.window_time("window").alias("at"), "event_type", "m")
        return at.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("hours"), F.avg("m").alias("mean"))

    out = _appended(spark, sf_dir, plan, "1 hour", 3)
    return out.select(_plain(F.col("window.start")).alias("day"), "event_type", "hours", F.round("mean", 6).alias("mean"))


@query("stream_outer_join", """SELECT a.event_id AS view, b.event_id AS purchase FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'view'""")
def stream_outer_join(spark, sf_dir):
    """Views with the purchases of the six hours after them, and views without one, which the watermark releases once; in three deliveries."""

    def plan(e):
        v = e.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("event_id").alias("view"), F.col("ts").alias("at"))
        p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "ts")
        return v.join(p, F.expr("u = user_id AND ts >= at AND ts <= at + INTERVAL 6 HOURS"), "left").select("view", "purchase")

    return _appended(spark, sf_dir, plan, "1 hour", 3)


@query("p38_moisture_spells", """WITH h AS (SELECT user_id AS zone, event_type AS depth, date_trunc('hour', ts) AS hour, avg(value) AS m FROM events GROUP BY 1, 2, 3),
g AS (SELECT zone, hour, CASE WHEN hour - lag(hour) OVER (PARTITION BY zone ORDER BY hour) <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT zone, hour FROM h)),
s AS (SELECT zone, hour, sum(new) OVER (PARTITION BY zone ORDER BY hour) AS spell FROM g)
SELECT zone, depth, min(min(hour)) OVER (PARTITION BY zone, spell) AS started, max(max(hour)) OVER (PARTITION BY zone, spell) AS ended, count(*) AS hours, round(avg(m), 6) AS mean, round(arg_max(m, hour), 6) AS last
FROM h JOIN s USING (zone, hour) GROUP BY zone, spell, depth""", "P")
def moisture_spells(spark, sf_dir):
    """Moisture by depth and zone, continuously: hour means feed the state of the zones, in as many buckets as the table asks for, and a timer closes a zone that has been silent for a day."""
    buckets = _buckets(spark, sf_dir)

    def plan(e):
        hours = e.groupBy(F.window("ts", "1 hour"), "user_id", "event_type").agg(F.avg("value").alias("mean"))
        rows = hours.select(F.col("user_id").alias("zone"), F.col("event_type").alias("depth"), F.window_time("window").alias("at"), F.col("window.start").alias("hour"), "mean")
        return stateful.moisture_spells(rows, 24, buckets)

    out = _appended(spark, sf_dir, plan, "1 hour", 2, conf=stateful.ROCKSDB)
    return out.select("zone", "depth", _plain(F.col("started")).alias("started"), _plain(F.col("ended")).alias("ended"), "hours", F.round("mean", 6).alias("mean"), F.round("last", 6).alias("last"))
