"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidgrid.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for the nodes that have an edge; ``edges`` has a and b of one type.

    A large star links the larger neighbours of a node to its smallest neighbour, a small star the
    smaller ones; both keep components. When no round changes an edge, each node is linked to the
    smallest node of its component. A round reads and writes one table.
    """
    pairs = edges.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    links = scratch.save(pairs.distinct(), f"{name}-0")
    state, turn = None, 0
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.withColumn("m", F.least("u", "m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        turn += 1
        links = scratch.save(small, f"{name}-{turn}")
        scratch.release(f"{name}-{turn - 1}")
        seen = links.agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("u", "v")).alias("h"),
        ).first()
        if state == (seen.n, seen.h):
            break
        state = (seen.n, seen.h)
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(tops)
