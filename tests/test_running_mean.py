"""The running mean before each row, where rounding of partial sums would show."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from sluice.operators import folds


def test_running_mean_is_not_rounded_by_its_days(spark):
    """Values in hundredths over nine days: the mean is that of their exact sum, whatever the partial sums are."""
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 3), f"2024-01-{1 + i // 40:02d} {i % 24:02d}:00:00", rng.randint(1, 6000)) for i in range(360)]
    want, cents = {}, {}
    for i, u, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        own = cents.setdefault(u, [])
        want[i] = float(Fraction(sum(own), 100)) / len(own) if own else None
        own.append(v)
    df = spark.createDataFrame([(i, u, t, v / 100) for i, u, t, v in rows], "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = folds.running_mean_before(df, "user_id", ("ts", "event_id"), "value", "m")
    assert set(out.columns) == {*df.columns, "m"}
    assert {r.event_id: r.m for r in out.collect()} == want


def test_running_mean_of_values_that_no_decimal_holds(spark):
    rows = [(1, 1, "2024-01-01", 1e300), (2, 1, "2024-01-02", 2e300), (3, 1, "2024-01-03", 1e-12), (4, 2, "2024-01-01", None), (5, 2, "2024-01-02", 0.5), (6, 2, "2024-01-03", 1e-13), (7, 2, "2024-01-04", 0.0), (8, 3, "2024-01-01", float("nan")), (9, 3, "2024-01-02", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.event_id: r.m for r in folds.running_mean_before(df, "user_id", ("ts", "event_id"), "value", "m").collect()}
    assert [got[i] for i in range(1, 8)] == [None, 1e300, 1.5e300, None, None, 0.5, (0.5 + 1e-13) / 2] and got[8] is None and got[9] != got[9]
