"""Connected components by alternating large-star and small-star steps, each a few joins over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Written


def _sum(e: Written) -> tuple:
    return tuple(e.df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame) -> Written:
    """edges (a, b) of any order, with repeats or loops -> table (node, root), root the smallest node of the component; nodes without an edge to another node are absent.

    Each step writes its edges to the shared folder, which cuts the lineage. The smallest neighbours are
    aggregated before they are shuffled and written before they are joined, so a node with a third of
    all edges can be split by the join.
    """
    e = Written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _sum(e)
    while state[0]:
        both = e.df.unionByName(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = Written(both.where("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = Written(large.df.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.df.join(low.df, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.df.select("u", F.col("m").alias("v")))
        after = Written(small.distinct(), "edges")
        for w in (e, least, large, low):
            w.drop()
        e, before, state = after, state, _sum(after)
        if state == before:
            break
    out = Written(e.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    e.drop()
    return out
