"""Reports on candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at(pairs: DataFrame, truth: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, found, total, recall): R with an owner whose owner is among their first k candidates. One job for all k."""
    hits = truth.select("r_id", "s1_id").join(pairs.select("r_id", "s1_id", "rank"), ["r_id", "s1_id"], "left")
    best = hits.groupBy("r_id").agg(F.min("rank").alias("rank"))
    each = best.select("rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return each.groupBy("k").agg(F.sum((F.coalesce(F.col("rank") < F.col("k"), F.lit(False))).cast("long")).alias("found"), F.count(F.lit(1)).alias("total")).withColumn("recall", F.col("found") / F.col("total"))


def blocking_report(pairs: DataFrame, truth: DataFrame, s1: DataFrame, r: DataFrame) -> DataFrame:
    """Per block and over all (block null): pairs, candidates per S1 (mean, median, p90, p99, max, without any), reduction against all pairs of the blocks, pair and entity completeness.

    s1: (s1_id, block), r: (r_id, block); quantiles are linear. Grouping sets give the total of what is counted once per S1.
    """
    n = pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    hit = pairs.select("s1_id", "r_id", F.lit(1).alias("hit"))
    true = truth.join(hit, ["s1_id", "r_id"], "left").groupBy("s1_id").agg(F.count(F.lit(1)).alias("nt"), F.sum(F.coalesce("hit", F.lit(0))).alias("nf"))
    each = s1.join(n, "s1_id", "left").join(true, "s1_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "nt", "nf")})
    q = lambda x: F.percentile("n", F.lit(x))
    told = each.groupingSets([["block"], []], "block").agg(
        F.count(F.lit(1)).alias("n_s1"), F.sum("n").alias("n_pairs"), F.avg("n").alias("mean"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("n").alias("max"),
        F.sum((F.col("n") == 0).cast("long")).alias("n_without"), (F.sum("nf") / F.nullif(F.sum("nt"), F.lit(0))).alias("pair_completeness"),
        F.avg(F.when(F.col("nt") > 0, (F.col("nf") == F.col("nt")).cast("double"))).alias("entity_completeness"),
    )
    space = s1.groupBy("block").agg(F.count(F.lit(1)).alias("a")).join(r.groupBy("block").agg(F.count(F.lit(1)).alias("b")), "block", "left")
    space = space.groupingSets([["block"], []], "block").agg(F.sum(F.col("a") * F.coalesce("b", F.lit(0))).alias("all_pairs")).withColumnRenamed("block", "_block")
    return told.join(space, F.col("block").eqNullSafe(F.col("_block"))).withColumn("reduction", 1 - F.col("n_pairs") / F.nullif("all_pairs", F.lit(0))).drop("_block")
