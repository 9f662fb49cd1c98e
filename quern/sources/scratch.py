"""A folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, as in tests, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def parquet(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is read several times or ends a lineage. `clear` deletes it.

    The shuffle files of the write go with it, as nothing reads them again; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/quern/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(table: DataFrame) -> None:
    """Deletes a table that `parquet` has written and that nothing reads again."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folder))
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that `parquet` has written: for after the results that read them are written elsewhere."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/quern")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
