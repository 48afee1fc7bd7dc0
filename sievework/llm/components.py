"""Connected components by alternating large and small stars, as joins and aggregates; nothing but two numbers a round goes to the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of comparable ids -> (node, root): each node of an edge with the smallest node that it reaches.

    A round hangs every larger neighbour of a node on the smallest one, then every smaller neighbour; the number of
    rounds grows with the logarithm of the components' sizes. Each round is a written table.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(least.select("u", "m")).distinct().toDF("a", "b"), "star")
        new = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
