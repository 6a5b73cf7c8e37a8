"""Connected components of a link table by alternating star contraction.

Each round is two grouped minima and two joins on the link table, cut by a written
table; rounds grow with the logarithm of the longest path.  A node with very many
links meets only partial aggregates and joins whose skewed side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked with the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked with the least of these; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    kept = edges.join(least, "b")
    links = kept.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return links.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) for every id in ``links`` (a, b); comp is the least id that is reachable.

    Repeated rows, both directions and loops are fine; rows with a null end are
    ignored; an empty table gives an empty table.
    """
    edges = scratch.save(
        links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    while True:
        # done when every b has one a, and no a is a b
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("up > 0 and down > 0 or down > 1").limit(1).count():
            break
        new = scratch.save(_small(_large(edges)))
        scratch.drop(edges)
        edges = new
    # a star by now: every b has one a, the least of its component
    return edges.select(F.col("b").alias("id"), F.col("a").alias("comp")).union(edges.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())
