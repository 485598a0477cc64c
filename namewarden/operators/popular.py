"""Popular package lists: by threshold, by count, merged with known targets, and narrowed for a popular query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewarden.config import POPULAR_AT_LEAST, POPULAR_AT_MOST


def low_is_popular(registry: str) -> bool:
    return registry in POPULAR_AT_MOST


def popularity_order(registry: str, column: str = "popularity") -> list[Column]:
    """Most popular first, ties by name."""
    return [F.col(column).asc_nulls_last() if low_is_popular(registry) else F.col(column).desc_nulls_last(), F.col("package_name").asc()]


def popular(packages: DataFrame, registry: str, top: int | None = None, threshold: float | None = None) -> DataFrame:
    """(package_name, popularity), most popular first: the ``top`` ones, or those past the registry's threshold."""
    rows = packages.select("package_name", "popularity")
    if top is None:
        p = F.col("popularity")
        rows = rows.filter(p <= (POPULAR_AT_MOST[registry] if threshold is None else threshold) if low_is_popular(registry) else p >= (POPULAR_AT_LEAST[registry] if threshold is None else threshold))
    rows = rows.orderBy(*popularity_order(registry))
    return rows if top is None else rows.limit(top)


def with_targets(listed: DataFrame, truth: DataFrame, registry: str) -> DataFrame:
    """The list with the targets that it lacks on top, by name, at a popularity that stands for the most popular; the others follow as they are in order of theirs."""
    new = truth.select("package_name").filter("package_name <> ''").distinct().join(listed, "package_name", "left_anti")
    new = new.withColumn("popularity", F.lit(0.1 if low_is_popular(registry) else 9999999.0))
    both = new.withColumn("__old", F.lit(0)).unionByName(listed.select("package_name", "popularity", F.lit(1).alias("__old")))
    return both.orderBy("__old", *popularity_order(registry)).drop("__old")


def without(listed: DataFrame, names: DataFrame) -> DataFrame:
    """The list without the given names."""
    return listed.join(names.select("package_name").distinct(), "package_name", "left_anti")


def more_popular(own: Column, other: Column, registry: str) -> Column:
    """Whether a popular query's target is popular enough: ten times the downloads of a query under 10000, or at most half the rank."""
    if low_is_popular(registry):
        return (own > 1) & (other <= F.floor(own / 2))
    return (own < 10000) & (other >= 10 * own)


#: Rows of either side that a task compares, and most parts of a side.
ROWS, PARTS = 4096, 140


def narrowed(queries: DataFrame, listed: DataFrame, registry: str, rows: int = ROWS) -> DataFrame:
    """(query, package_name, popularity): the targets of queries that are popular themselves.

    Their number grows with the square of the rows; each part of the queries
    meets each part of the list in a task of its own, so tasks don't grow.
    """
    own = queries.select(F.col("package_name").alias("query")).join(listed.select(F.col("package_name").alias("query"), F.col("popularity").alias("own")), "query")
    part = lambda df: df.repartition(max(1, min(PARTS, -(-df.count() // rows))))
    targets = part(listed.select("package_name", "popularity")).hint("shuffle_replicate_nl")
    return part(own).join(targets, more_popular(F.col("own"), F.col("popularity"), registry)).select("query", "package_name", "popularity")


def far_more_popular(pairs: DataFrame, listed: DataFrame, registry: str) -> DataFrame:
    """The pairs (query, package_name) that ``narrowed`` has, worked out on the pairs alone."""
    once = listed.groupBy("package_name").agg(F.min("popularity").alias("least"), F.max("popularity").alias("most"))
    low = low_is_popular(registry)
    own = once.select(F.col("package_name").alias("query"), F.col("most" if low else "least").alias("__own"))
    other = once.select("package_name", F.col("least" if low else "most").alias("__other"))
    both = pairs.join(own, "query").join(other, "package_name")
    return both.filter(more_popular(F.col("__own"), F.col("__other"), registry)).select(*pairs.columns)
