"""Ordered folds of events into keyed state.

Each fold runs within (key, day) and adds what earlier days leave behind, read
from a table of one row per key and day; so a key with much of the data
is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; a grouped maximum, which combines before it is shuffled."""
    row = F.struct(*order, *(c for c in df.columns if c not in order))
    return df.groupBy(key).agg(F.max(row).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in df.columns))


def _day(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    return df.withColumn("_d", F.to_date(order[0]))


def toggle_parity(df: DataFrame, key: str, order: tuple[str, ...], toggles: Column) -> DataFrame:
    """df with is_open: whether the number of toggles so far is odd."""
    df = _day(df, order).withColumn("_x", F.when(toggles, 1).otherwise(0))
    inside = Window.partitionBy(key, "_d").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(key, "_d").agg(F.sum("_x").alias("n")).select(key, "_d", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_c"))
    out = df.withColumn("_n", F.sum("_x").over(inside)).join(carry, [key, "_d"])
    return out.withColumn("is_open", (F.col("_n") + F.col("_c")) % 2 == 1).drop("_d", "_x", "_n", "_c")


def toggle_with_reset(df: DataFrame, key: str, order: tuple[str, ...], toggles: Column, resets: Column) -> DataFrame:
    """df with is_open: whether the number of toggles since the last reset is odd; a reset closes."""
    df = _day(df, order).withColumns({"_x": F.when(toggles & ~resets, 1).otherwise(0), "_z": F.when(resets, 1).otherwise(0)})
    inside = Window.partitionBy(key, "_d").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_g", F.sum("_z").over(inside))
    since = Window.partitionBy(key, "_d", "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_n", F.sum("_x").over(since))
    # What a day leaves: its toggles after its last reset, and whether it had one.
    left = df.groupBy(key, "_d").agg(F.max_by("_n", F.struct(*order)).alias("tail"), F.max("_z").alias("had"))
    upto = Window.partitionBy(key).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = left.withColumn("era", F.sum("had").over(upto))
    run = Window.partitionBy(key, "era").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = left.withColumn("open", F.sum("tail").over(run))
    carry = left.select(key, "_d", F.coalesce(F.lag("open").over(Window.partitionBy(key).orderBy("_d")), F.lit(0)).alias("_c"))
    out = df.join(carry, [key, "_d"])
    total = F.col("_n") + F.when(F.col("_g") == 0, F.col("_c")).otherwise(0)
    return out.withColumn("is_open", total % 2 == 1).drop("_d", "_x", "_z", "_g", "_n", "_c")


def running_total(df: DataFrame, key: str, order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """df with the running sum of value (an exact type) of each key."""
    df = _day(df, order).withColumn("_v", value)
    inside = Window.partitionBy(key, "_d").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(key, "_d").agg(F.sum("_v").alias("n")).select(key, "_d", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_c"))
    out = df.withColumn("_n", F.sum("_v").over(inside)).join(carry, [key, "_d"])
    return out.withColumn(name, F.col("_n") + F.col("_c")).drop("_d", "_v", "_n", "_c")


def running_mean_before(df: DataFrame, key: str, order: tuple[str, ...], value: str, name: str) -> DataFrame:
    """df with the mean of value over the earlier rows of each key; null for its first row.

    Where all of a key's values so far have ten decimals at most, their sum is exact, so that neither the cut into days nor
    the order in which partial sums arrive rounds it; otherwise it is a sum of doubles.
    """
    exact = F.col(value).cast("double").try_cast("decimal(28,10)")
    df = _day(df, order).withColumn("_e", exact).withColumn("_o", F.when(F.col("_e").cast("double").eqNullSafe(F.col(value).cast("double")), 0).otherwise(1))
    inside = Window.partitionBy(key, "_d").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    days = df.groupBy(key, "_d").agg(F.sum(value).alias("s"), F.sum("_e").alias("e"), F.sum("_o").alias("o"), F.count(value).alias("n"))
    carry = days.select(key, "_d", *(F.coalesce(F.sum(c).over(before), zero).alias(f"_{c}0") for c in "seon"))
    own = {"_s": F.sum(value), "_e": F.sum("_e"), "_o": F.sum("_o"), "_n": F.count(value)}
    out = df.select(*df.columns[:-2], *(F.coalesce(a.over(inside), zero).alias(c) for c, a in own.items())).join(carry, [key, "_d"])
    whole = lambda c: F.col(f"_{c}") + F.col(f"_{c}0")
    total = F.when(whole("o") == 0, whole("e").cast("double")).otherwise(whole("s"))
    return out.withColumn(name, F.try_divide(total, whole("n"))).drop("_d", *own, *(f"{c}0" for c in own))


def with_neighbours(df: DataFrame, key: str, order: tuple[str, ...], value: str, back: int, ahead: int, ends: bool = False) -> DataFrame:
    """df with _before and _after, arrays of structs (v) of the value in up to back rows before each row of its key, and ahead rows after it, in order; and _rank, its number from 1.
    With ends, also _firsts and _lasts: the values of up to ahead first and back last rows of the key.

    Rows are windowed within (key, day). A day's first and last few values, one row per key and
    day, tell its neighbours what they lack: every day has a row, so that so many days are enough.
    """
    df = _day(df, order).withColumn("_v", F.struct(F.col(value).alias("v")))
    day = Window.partitionBy(key, "_d").orderBy(*order)
    # One pass over each day: what lies before and after each row, which also tells a day's last rows.
    leads = max(ahead, back if back > 1 else 0)
    near = {f"_p{i}": F.lag("_v", i).over(day) for i in range(1, back + 1)} | {f"_f{i}": F.lead("_v", i).over(day) for i in range(1, leads + 1)}
    df = df.withColumns({"_rank": F.row_number().over(day).cast("long"), **near})
    there = lambda cols: F.filter(F.array(*cols), lambda x: x.isNotNull()) if cols else F.array().cast(f"array<{df.schema['_v'].dataType.simpleString()}>")
    nth_last = lambda i: F.col(f"_f{i}").isNull() & (F.col(f"_f{i - 1}").isNotNull() if i > 1 else F.lit(True))
    head = [F.max(F.when(F.col("_rank") == i, F.col("_v"))) for i in range(1, ahead + 1)]
    tail = [F.max(F.when(nth_last(i), F.col("_v"))) for i in range(back, 0, -1)] if back > 1 else [F.max(F.struct(*order, "_v"))["_v"]] * back
    edges = df.groupBy(key, "_d").agg(there(head).alias("head"), there(tail).alias("tail"), F.count("*").alias("n"))
    days = Window.partitionBy(key).orderBy("_d")
    around = lambda c, a, b: F.flatten(F.collect_list(c).over(days.rowsBetween(a, b)))
    carry = edges.select(
        key, "_d", "head", "tail", (around("tail", -back, -1) if back else there([])).alias("_prior"), (around("head", 1, ahead) if ahead else there([])).alias("_next"),
        F.coalesce(F.sum("n").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_done"))
    if ends:
        whole = days.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carry = carry.withColumns({"_firsts": F.first(F.slice(F.concat("head", "_next"), 1, ahead)).over(whole), "_lasts": F.last(F.slice(F.concat("_prior", "tail"), -back, back)).over(whole)})
    carry = carry.drop("head", "tail")
    out = df.withColumns({"_before": there([F.col(f"_p{i}") for i in range(back, 0, -1)]), "_after": there([F.col(f"_f{i}") for i in range(1, ahead + 1)])})
    out = out.drop("_v", *near).join(carry, [key, "_d"])
    lack, short = back - F.size("_before"), ahead - F.size("_after")
    prior = F.slice("_prior", F.greatest(F.lit(1), F.size("_prior") - lack + 1), F.greatest(F.lit(0), lack))
    return out.withColumns({"_before": F.concat(prior, "_before"), "_after": F.concat("_after", F.slice("_next", 1, F.greatest(F.lit(0), short))), "_rank": F.col("_rank") + F.col("_done")}).drop("_d", "_prior", "_next", "_done")
