"""Connected components of a large graph, as DataFrame rounds whose state lives in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node that can be reached. Loops and nulls don't count.

    Alternating large-star and small-star rounds: every round links a node's neighbours to the least of them, found by an
    aggregation with partial sums, and the number of rounds grows with the logarithm of the longest path. Each round is
    written to the shared folder, so a lost executor costs one round. Nothing is gathered on the driver but two sums.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = keep(edges.where("a is not null and b is not null and a != b").select(u, v).distinct(), "edges")
    sign = _signature(now)
    while sign[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = keep(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        done = (then := _signature(after)) == sign
        drop(now)
        now, sign = after, then
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
