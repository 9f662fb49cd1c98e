"""The driver's tables in the roles of linkage data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.vectors import hashed
from quern.sources.records import vector


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every fifth embedding is an S1, the others are R; the label is the block."""
    all_rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("block"), vector("embedding").alias("vec"))
    r = all_rows.filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("r_id"), "block", "vec", (2 + F.col("vec_id") % 2).cast("int").alias("src"), (F.col("vec_id") % 7 == 0).alias("addr_missing"))
    return r, all_rows.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("s1_id"), "block", "vec")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts and orders of lineitem as scored pairs (s1_id, r_id, p, cos, src)."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("s1_id"), F.col("l_orderkey").alias("r_id")).agg(F.round(1 - F.min("l_tax"), 6).alias("cos"))
    p = ((F.col("r_id") * 7919 + F.col("s1_id") * 104729) % 1000) / 1000.0
    return rows.select("s1_id", "r_id", p.alias("p"), "cos", (2 + F.col("r_id") % 2).cast("int").alias("src"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of returned lines one part for each order."""
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("r_id")).agg(F.min("l_partkey").alias("s1_id"))


def everyone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("s1_id"), F.col("p_brand").alias("country"))


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as S1 and orders as R records, and who owns which order."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_nationkey").cast("string").alias("country"), F.col("c_name").alias("name_raw"), F.lit(1).alias("src"))
    o = table(spark, sf_dir, "orders")
    r = o.select(F.concat(F.lit("R-"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.lit(None).cast("string").alias("country"), F.col("o_orderpriority").alias("name_raw"), (2 + F.col("o_orderkey") % 2).cast("int").alias("src"))
    owners = o.filter("o_orderstatus <> 'P'").select(F.concat(F.lit("R-"), F.col("o_orderkey").cast("string")).alias("r_id"), F.concat(F.lit("S1-"), F.col("o_custkey").cast("string")).alias("s1_id"))
    return c.unionByName(r), owners


def text_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hashed trigrams of documents' whole texts: every fifth document is an S1, the others are R; the language is the block."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("block"), hashed(F.lower(F.coalesce("text", F.lit(""))), 64).alias("vec"))
    r = rows.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("r_id"), "block", "vec")
    return r, rows.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("s1_id"), "block", "vec")
