from pyspark.sql import functions as F

from sluice.session import clear_scratch, shared_dir
from sluice.sources.tables import round_trip


def test_scratch_is_cleared_when_asked(spark):
    got = round_trip(spark.range(5).select(F.col("id").alias("k")), "parquet")
    assert got.count() == 5 and shared_dir(spark)
    assert clear_scratch(spark) and not clear_scratch(spark)
