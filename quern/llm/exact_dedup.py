"""Exact deduplication by a content sort (operator 8). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, fresh, partitions, text_or_empty

#: Bytes of the normalised text that splitters hold, before a hash of the whole.
LEAD = 48
#: Parts that a group of equal texts is dealt to at least; there are as many as shuffle partitions if these are more.
SALTS = 32


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", salts: int | None = None) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are after lower-casing A-Z; a null text is an empty one. Of equal texts
    the row with the smallest id stays, or with the largest if `keep` says so; a null id comes last either
    way. Rows that share text and id are kept or dropped together. Other columns of df are ignored.

    The content sort: sampled splitters range-partition the normalised bytes, an external sort brings equal
    ones together, and the window compares a row's whole text with its neighbour's. A splitter is the
    text's first bytes and a hash of all of them, as whole texts would fill the driver; within a partition
    the order goes on by the whole text. A group of copies may hold a third of all rows, so the first sort
    also splits by `salts` classes of the id, and only the first row of each class takes part in a second
    sort over all classes. Rows find the result by their class's first row. Unless given, `salts` grows with
    the shuffle partitions, so a class of the largest group is no more than a partition's share of the rows.
    """
    order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    n = partitions(df.sparkSession)
    salts = salts or max(SALTS, n)
    norm = ascii_lower(text_or_empty(text_col))
    rows = df.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumns({"lead": F.substring(F.encode("norm", "utf-8"), 1, LEAD), "hash": F.xxhash64("norm")})

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(salts))).repartitionByRange(n, "lead", "hash", "salt")
    run = W.partitionBy("lead", "hash", "salt", "norm")
    classes = salted.select(
        "id", "lead", "hash", "norm",
        F.first("id").over(run.orderBy(order)).alias("first_id"),
        F.row_number().over(run.orderBy(order)).alias("place"),
        F.count(F.lit(1)).over(run).alias("n"),
    )
    run = W.partitionBy("lead", "hash", "norm")
    firsts = classes.filter("place = 1").select("id", "lead", "hash", "norm", "n").repartitionByRange(n, "lead", "hash")
    groups = firsts.select(F.col("id").alias("class_id"), F.sha2("norm", 256).alias("class_sha"), F.first("id").over(run.orderBy(order)).alias("keep_id"), F.sum("n").over(run).alias("group_size"))
    members = classes.select("id", "first_id", F.sha2("norm", 256).alias("text_sha256"))
    # Null-safe also for the digests: else a filter for nulls is pushed below one of the two uses of `salted`, which then don't share their exchange.
    found = members.join(groups, F.col("first_id").eqNullSafe(F.col("class_id")) & F.col("text_sha256").eqNullSafe(F.col("class_sha")))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of df that `exact_groups` keeps, with all their columns, whatever their names. Rows of one id with different texts are kept or dropped each by its own text."""
    key, digest = fresh(df, "kept_id", "kept_sha")
    kept = exact_groups(df, id_col, text_col, keep).filter("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(digest)).distinct()
    own = F.sha2(ascii_lower(text_or_empty(text_col)), 256)  # compared null-safe for the same reason as in `exact_groups`
    return df.join(kept, F.col(id_col).eqNullSafe(F.col(key)) & own.eqNullSafe(F.col(digest)), "left_semi")
