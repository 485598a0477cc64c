"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewarden.llm.common import cut


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node on the least of them.

    Large: those above the node; small: those below it and the node itself. A
    node's least neighbour is a grouped minimum, so hubs are combined before
    the shuffle, and the join on the node may be split by adaptive execution.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        new = both.filter("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
    else:
        down = edges.select(F.col("a").alias("b"), F.col("b").alias("a"))  # a: the larger end
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        new = down.join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
        new = new.union(least.select(F.col("a").alias("hi"), F.col("m").alias("lo")))
    return new.filter("hi <> lo").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, root the least node it reaches.

    ``edges``: two columns of one orderable type; loops, repeats and nulls are
    allowed and say nothing. No link: an empty table. Rounds grow with the
    logarithm of a component's size; each is checkpointed.
    """
    x, y = edges.columns
    edges = edges.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col("a") < F.col("b"))).distinct()
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    edges, before = cut(edges), None
    while True:
        now = edges.agg(mark.alias("m")).first().m
        if now == before or not now.n:
            break
        before, edges = now, cut(_step(_step(edges, large=True), large=False))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
