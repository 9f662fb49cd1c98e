import os
import time

from pyspark.sql import functions as F

from quern.sources import scratch


def shuffle_files(spark):
    at = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in at for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    out = scratch.parquet(df, "test")
    until = time.time() + 10  # they are deleted in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(scratch.CLEANUP, None) in (None, "false")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
