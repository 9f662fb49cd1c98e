"""Folds and samples by stable hashes of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import bucket, in_sample


def with_folds(records: DataFrame, owners: DataFrame, n: int = 10, labelled: bool = True) -> DataFrame:
    """Adds true_s1 (the record's owner, an S1's own id, or null) and bucket: that of the owner's id, else of its own; -1 without labels."""
    if not labelled:
        return records.withColumns({"true_s1": F.lit(None).cast("string"), "bucket": F.lit(-1)})
    owned = records.join(owners.select(F.col("r_id").alias("entity_id"), F.col("s1_id").alias("_owner")), "entity_id", "left")
    own = F.when(F.col("src") == 1, F.col("entity_id")).otherwise(F.col("_owner"))
    return owned.withColumn("true_s1", own).withColumn("bucket", bucket(F.coalesce("true_s1", "entity_id"), n)).drop("_owner")


def density_fraction(owners: DataFrame, records: DataFrame, test_density: float) -> DataFrame:
    """The share of S1 to remove so that R records without an S1, for each S1, become as many as in the test data: max(0, (d' - d) / (m + d')), with m matches and d others for each S1."""
    counts = records.agg(F.sum((F.col("src") == 1).cast("int")).alias("n1"), F.sum((F.col("src") != 1).cast("int")).alias("nr"))
    matched = owners.agg(F.count(F.lit(1)).alias("nm"))
    both = counts.unionByName(matched, allowMissingColumns=True).agg(F.max("n1").alias("n1"), F.max("nr").alias("nr"), F.max("nm").alias("nm"))
    m, d = F.col("nm") / F.col("n1"), (F.col("nr") - F.col("nm")) / F.col("n1")
    return both.select(F.greatest(F.lit(0.0), (F.lit(test_density) - d) / (m + F.lit(test_density))).alias("fraction"))


def densified(records: DataFrame, fraction: float, salt: str = "densify:") -> DataFrame:
    """Without the S1 of a fraction by hash, whose R records lose their owner. records: with true_s1."""
    gone = in_sample(F.col("true_s1"), fraction, salt)
    return records.filter((F.col("src") != 1) | ~gone).withColumn("true_s1", F.when(~F.coalesce(gone, F.lit(False)), F.col("true_s1")))


def cluster_sample(records: DataFrame, fraction: float) -> DataFrame:
    """Whole clusters, of a fraction in thousandths."""
    return records.filter(bucket(F.coalesce("true_s1", "entity_id"), 1000) < int(fraction * 1000))


def slice_by_regex(records: DataFrame, pattern: str, text: str) -> DataFrame:
    """The records whose text matches, and all others of their clusters, so that the density stays."""
    hit = records.filter(F.col(text).rlike(pattern))
    owners = hit.select(F.coalesce("true_s1", "entity_id").alias("_cluster")).distinct()
    return records.withColumn("_cluster", F.coalesce("true_s1", "entity_id")).join(owners, "_cluster", "left_semi").drop("_cluster")
