"""Readers and writers of the linkage data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "country", "business_name", "business_address")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A tab-separated file with a header, without quotes and inference: all strings; an empty field is null, a literal NULL stays."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("inferSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """As `read_tsv` reads it, in as many parts as df has partitions."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("lineSep", "\n").csv(path)


def tagged_union(sources: dict[int, DataFrame]) -> DataFrame:
    """Stacks sources, each tagged by its number in `src`, with the names that the rest uses."""
    out: DataFrame | None = None
    for tag, df in sources.items():
        one = df.withColumnsRenamed({"business_name": "name_raw", "business_address": "addr_raw"}).withColumn("src", F.lit(tag).cast("tinyint"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no sources")
    return out


def explode_id_list(df: DataFrame, key: str, ids: str, out: str = "r_id") -> DataFrame:
    """A wide row (key, "a,b,c") as rows (key, id); empty ids and empty lists give none."""
    return df.select(key, F.explode(F.split(ids, ",")).alias(out)).filter((F.col(out) != "") & F.col(out).isNotNull())


def id_lists(pairs: DataFrame, everyone: DataFrame, s1: str = "s1_id", r: str = "r_id", out: str = "matched_ids") -> DataFrame:
    """One row for every S1: its distinct R ids in order, joined by commas; "" if it has none."""
    lists = pairs.groupBy(s1).agg(F.array_join(F.transform(F.array_sort(F.collect_set(r)), lambda x: x.cast("string")), ",").alias(out))
    return everyone.select(s1).distinct().join(lists, s1, "left").withColumn(out, F.coalesce(out, F.lit("")))


def write_report(spark: SparkSession, values: dict[str, float | int | str], path: str) -> None:
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> dict[str, float | int | str]:
    return spark.read.json(path).first().asDict()


def write_dictionaries(tokens: DataFrame, components: DataFrame, path: str) -> None:
    tokens.write.mode("overwrite").parquet(f"{path}/tokens")
    components.write.mode("overwrite").parquet(f"{path}/components")


def read_dictionaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/components")


def vector(column: str) -> Column:
    """A stored float vector as doubles, for arithmetic."""
    return F.col(column).cast("array<double>")
