"""Connected components of links, by alternating star contraction on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link with the smallest node it reaches; null ends are left out.

    Each round joins all neighbours of a node to its smallest neighbour, first upwards, then
    downwards, which keeps what is connected. It ends when every link leads from a node to a root;
    a component of diameter d needs about log(d) rounds. Every round is written to the shared folder.
    """
    edges = stage(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                  .filter(F.col("b").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
                  .distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if _is_forest_of_stars(edges):
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether no node has two roots and no root leads on."""
    ends = edges.select("a", F.lit(1).alias("parents"), F.lit(0).alias("root")) \
        .unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("parents"), F.lit(1).alias("root")))
    return ends.groupBy("a").agg(F.sum("parents").alias("parents"), F.max("root").alias("root")) \
        .filter(F.col("parents") + F.col("root") > 1).isEmpty()


def merge_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of before with the components that links (a, b) between nodes join made one.

    Only the links between different roots are looked at, so a later call works on a small graph.
    """
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = connected_components(links.join(left, "a").join(right, "b"), "ra", "rb")
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return stage(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
