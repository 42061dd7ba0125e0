"""Connected components of links between documents or fingerprints, by star contraction.

Each round hangs every node on its least neighbour, first among the larger and then
among the smaller ones, until all links point at the least node of a component.
Links never grow in number, a node of any degree is summed before it is joined, and
every round reads a written table, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.operators.spread import staged


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _hang(both: DataFrame, kind: str) -> DataFrame:
    """Links from the neighbours v of each node u, and from u, to the least of them."""
    # Written, so that the join with the links is one that Spark can split at hot nodes.
    least = staged(both.groupBy("u").agg(F.min("v").alias("_least")).withColumn("_least", F.least("u", "_least")), f"components_{kind}")
    joined = both.join(least, "u")
    if kind == "large":
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("_least").alias("b"))
    else:
        moved = joined.filter("v <> _least").select(F.col("v").alias("a"), F.col("_least").alias("b")).union(
            least.filter("u <> _least").select(F.col("u").alias("a"), F.col("_least").alias("b")))
    return staged(moved.filter("a <> b").distinct(), f"components_{kind}_links")


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """One row (node, label) per node with a link; the label is the least node of its component.

    Nodes can be of any type that Spark orders; null and self links are left out; an
    empty table gives an empty result.
    """
    pairs = staged(links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"),
                                (F.col(left).isNotNull() & F.col(right).isNotNull()).alias("_whole"))
                   .filter("_whole AND a <> b").select("a", "b").distinct(), "components_links")
    before = None
    while (state := _state(pairs)) != before:
        before = state
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _hang(both, "large")
        pairs = _hang(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "small")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
