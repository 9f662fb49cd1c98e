"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v): component is the smallest node that it reaches.

    Each round every node joins its smallest neighbour, if that is smaller than itself, and the edges are
    contracted, which at least halves the nodes that still have edges. A star, however large, takes one
    round: the minimum is a partial aggregation and the joins can be split at hot nodes. Rounds are cut by
    written tables; the driver sees only whether edges are left. Loops, repeats and nulls are ignored.
    """
    edges = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("to")), "step")
        if found is None:
            found = step.select("node", F.col("to").alias("component"))
        else:
            moved = found.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            found = written(moved, "found")
        u = edges.join(step.select(F.col("node").alias("u"), F.col("to").alias("tu")), "u")
        uv = u.join(step.select(F.col("node").alias("v"), F.col("to").alias("tv")), "v")
        edges = written(uv.select(F.col("tu").alias("u"), F.col("tv").alias("v")).filter("u <> v").distinct(), "edges")
    return found if found is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
