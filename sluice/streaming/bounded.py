"""Reading tables as streams, and running a query over all that is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.session import shared_dir


def stream(spark: SparkSession, sf_dir: str, name: str, time: str | None = None) -> DataFrame:
    """A table as a stream of its files; the event time becomes a timestamp, which watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    # As a pattern, since a stream's plain path has to be a folder and a table may be one file.
    got = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
    return got if time is None else got.withColumn(time, F.col(time).cast("timestamp"))


def new_root(spark: SparkSession) -> str:
    """A folder for the state and the output of one query."""
    return f"{shared_dir(spark)}/sluice/stream-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; they are put back afterwards, whatever happens."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(df: DataFrame, mode: str, root: str | None = None, conf: dict[str, str] | None = None, progress: list | None = None) -> DataFrame:
    """Run a streaming query over all available input, and return its result table.

    conf holds while it runs; what Spark reports of each batch is added to progress.

    A second run with the same root goes on where the first one ended.

    In complete mode each batch replaces the table; in append and update mode
    it adds to it. Every batch is written under its own number, so a
    batch that is run again replaces itself.
    """
    spark = df.sparkSession
    root = root or new_root(spark)

    def write(batch: DataFrame, number: int) -> None:
        to = f"{root}/out/batch=0" if mode == "complete" else f"{root}/out/batch={number}"
        batch.write.mode("overwrite").parquet(to)

    with settings(spark, conf or {}):
        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        if progress is not None:
            progress += q.recentProgress
    return spark.read.schema(df.schema).parquet(f"{root}/out/batch=*")


def heartbeats(rows: DataFrame, time: str, by: str, after: str) -> DataFrame:
    """A row of each value of by, so long after the last row, with nothing else in it: it says that time goes on, and lets watermarks pass all rows."""
    last = rows.groupBy(by).agg(F.max(time).alias("t")).select(by, F.max("t").over(Window.partitionBy(F.lit(1))).alias("t"))
    fill = {time: F.col("t") + F.expr(f"INTERVAL {after}"), by: F.col(by)}
    return last.select(*(fill.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))


def run_to_end(spark: SparkSession, sf_dir: str, name: str, time: str, by: str, plan: Callable[[DataFrame], DataFrame], delay: str, deliveries: int = 1, conf: dict[str, str] | None = None, progress: list | None = None) -> DataFrame:
    """What plan appends over a table that arrives as a stream, once its watermark has passed all rows.

    plan gets the stream with its watermark. The table arrives whole, with delay longer
    than it spans, or in so many deliveries, one stretch of time after another, each
    run from where the one before ended. Heartbeats come last. They share
    the sources' watermark but are not rows of the table: what they alone open stays open.
    """
    root = new_root(spark)
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path).withColumn(time, F.col(time).cast("timestamp"))
    rows.limit(0).write.parquet(f"{root}/beat")
    parts = [None]
    if deliveries > 1:
        low, high = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
        at = F.floor((F.unix_micros(time) - (low or 0)) * deliveries / ((high or 0) - (low or 0) + 1))
        rows.limit(0).write.parquet(f"{root}/in")
        parts = [rows.where(at == i) for i in range(deliveries)]

    def source() -> DataFrame:
        given = stream(spark, sf_dir, name, time) if deliveries == 1 else spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        return plan(given.unionByName(spark.readStream.schema(rows.schema).parquet(f"{root}/beat")).withWatermark(time, delay))

    for part in parts:
        if part is not None:
            part.write.mode("append").parquet(f"{root}/in")
        run(source(), "append", root, conf, progress)
    heartbeats(rows, time, by, "1000 days").write.mode("append").parquet(f"{root}/beat")
    return run(source(), "append", root, conf, progress)
