"""Streams of records against a static index, and windowed counts of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import blocking
from quern.sources.records import vector
from quern.sources.scratch import scratch


def files(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream of its files."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).option("recursiveFileLookup", False).parquet(folder)


def source(spark: SparkSession, path: str) -> DataFrame:
    """One file, or a folder of files, as a stream."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return files(spark, path)


def daily(spark: SparkSession, path: str, delay: str = "7 days") -> DataFrame:
    """Counts and sums a day and type of event, by a watermarked window that runs until what is there is read."""
    made = source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    told = made.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "total")
    out = f"{scratch(spark)}/daily-{uuid.uuid4().hex}"
    spark.createDataFrame([], told.schema).write.parquet(out)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)  # each batch has all windows

    told.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(out)


def linked(spark: SparkSession, path: str, k: int) -> DataFrame:
    """R vectors as they come, each batch against the static S1; a batch that is run again replaces what it wrote."""
    out = f"{scratch(spark)}/linked-{uuid.uuid4().hex}"
    s1 = spark.read.parquet(path).filter("vec_id % 5 = 0").select(F.col("vec_id").alias("s1_id"), F.col("label").alias("block"), vector("embedding").alias("vec"))
    r = source(spark, path).filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("r_id"), F.col("label").alias("block"), vector("embedding").alias("vec"))

    def link(batch: DataFrame, number: int) -> None:
        blocking.knn(batch, s1, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    r.writeStream.foreachBatch(link).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")
