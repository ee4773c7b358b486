"""Tables of an input folder, and round trips through other formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import shared_dir


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views for SQL text."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """HTML files of a folder, whole: page (file name without ending) and html."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]+)\.html?$", 1).alias("page"), F.col("value").alias("html"))


def round_trip(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """Write df in a format to the shared folder and read it back with its own schema."""
    path = f"{shared_dir(df.sparkSession)}/sluice/{kind}-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).options(**options).schema(df.schema).load(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage: a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/sluice/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitioned(df: DataFrame, *by: str) -> DataFrame:
    """df written partitioned by columns, and read back so that filters on them prune folders. Each task writes its own rows to every folder: a value with much of the table is not one task's."""
    path = f"{shared_dir(df.sparkSession)}/sluice/by-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def catalogue_table(df: DataFrame, *more: DataFrame) -> DataFrame:
    """df created as a table of the catalogue, other frames appended to it, and the table read back; its files are in the shared folder."""
    spark, name = df.sparkSession, f"sluice_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}) USING parquet LOCATION '{shared_dir(spark)}/sluice/{name}'")
    for part in (df, *more):
        part.write.insertInto(name)
    got = spark.table(name)
    got.schema  # noqa: B018  resolved now: dropping an external table leaves its files
    spark.sql(f"DROP TABLE {name}")
    return got


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key, and its other rows added; one join, whatever changes."""
    row = lambda df, name: df.select(F.col(key).alias(f"_{name}"), F.struct(*df.columns).alias(name))
    both = row(old, "old").join(row(new, "new"), F.col("_old") == F.col("_new"), "full")
    return both.select(F.coalesce("new", "old").alias("r")).select("r.*")
