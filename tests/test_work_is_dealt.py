"""Work that a few bytes stand for is dealt to many tasks."""

from pyspark.sql import functions as F

from driftloom.operators import smooth


def test_smooth_fits_run_in_many_tasks(spark):
    df = spark.range(1200).selectExpr("id % 40 as k", "cast(id as double) x", "sin(id / 90) y")
    fits = smooth.additive(df, ["k"], F.col("y"), ["x"])
    got = fits.withColumn("p", F.spark_partition_id()).select("k", "p").collect()
    assert len(got) == 40 and len({r.p for r in got}) > 1
