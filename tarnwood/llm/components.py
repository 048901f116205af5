"""Connected components of an edge table, by stars, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (columns a, b): the least node reachable.

    Large-star and small-star steps in turn: a step replaces a node's edges by edges to its
    least neighbour, counts fold map-side, and each round's edges are written to the shared
    folder. Ends when a round changes nothing, after a number of rounds that grows with the
    logarithm of the edges. Edges with a null end or between equal nodes say nothing."""
    now = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last = common.written(now, "edges"), None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if sign == last or not sign["n"]:
            break
        last = sign
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = common.joined(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = common.joined(large, low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = common.written(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    member = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return member.unionByName(member.select(F.col("component").alias("node"), "component").distinct())
