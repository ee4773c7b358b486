"""Queries that fold ordered events into keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import html as H
from sluice.operators import folds
from sluice.registry import query
from sluice.sources.tables import load

LATEST_SQL = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def _latest(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return folds.latest_per_key(rows, "user_id", "ts", "event_id").drop("ts")


@query("r04_latest_per_key", LATEST_SQL, "R")
def latest_per_key(spark, sf_dir):
    """The last write of each key wins."""
    return _latest(spark, sf_dir)


@query("r05_state_default", f"SELECT c_custkey, coalesce(nullif(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, ''), 'es') AS choice FROM customer LEFT JOIN ({LATEST_SQL}) ON c_custkey = user_id", "R")
def state_default(spark, sf_dir):
    """A stored choice for every customer, where none or an empty one gives the default."""
    state = _latest(spark, sf_dir).select("user_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("stored"))
    joined = load(spark, sf_dir, "customer").join(state, F.col("c_custkey") == F.col("user_id"), "left")
    return joined.select("c_custkey", H.wanted_language(F.col("stored")).alias("choice"))


@query("r09_toggle_parity", "SELECT event_id, user_id, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 = 1, false) AS is_open FROM events", "R")
def toggle_parity(spark, sf_dir):
    """Open or closed after each event, when clicks toggle."""
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return folds.toggle_parity(rows, "user_id", ("ts", "event_id"), F.col("event_type") == "click").select("event_id", "user_id", "is_open")


@query("r10_toggle_with_reset", """WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM events)
SELECT event_id, user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, era ORDER BY ts, event_id) % 2 = 1 AS is_open FROM g""", "R")
def toggle_with_reset(spark, sf_dir):
    """The same, when errors force it closed."""
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = folds.toggle_with_reset(rows, "user_id", ("ts", "event_id"), F.col("event_type") == "click", F.col("event_type") == "error")
    return out.select("event_id", "user_id", "is_open")
