"""Changes of tables: inserts that ignore what is there, upserts, ordered lists without repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(rows: DataFrame) -> Column:
    """A hash of all columns; maps and variants, which have none, count by their JSON."""
    hashable = lambda f: not any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    named = lambda f: "`" + f.name.replace("`", "``") + "`"
    return F.xxhash64(*(F.col(named(f)) if hashable(f) else F.to_json(F.struct(named(f))) for f in rows.schema))


def insert_ignore(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows that an insert adds: new keys, once each."""
    return new.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: str, updated: str = "updated_at", created: str = "created_at") -> DataFrame:
    """The table with the latest row of each key; created stays the earliest. Of rows as late, a new one stays, then the one of the least hash."""
    rows = table.withColumn("__old", F.lit(1)).unionByName(new.withColumn("__old", F.lit(0)), allowMissingColumns=True)
    latest = Window.partitionBy(key).orderBy(F.col(updated).desc_nulls_last(), "__old", row_hash(rows.drop(created)))
    out = rows.withColumns({"__n": F.row_number().over(latest), created: F.min(created).over(Window.partitionBy(key))})
    return out.filter("__n = 1").drop("__n", "__old")


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def first_distinct(lists: Sequence[DataFrame], key: str, n: int) -> DataFrame:
    """(key, place): the first n keys of lists put one behind another, repeats left out; each list has (key, place)."""
    rows = None
    for i, one in enumerate(lists):
        one = one.select(key, F.struct(F.lit(i).alias("list"), F.col("place").cast("long").alias("place")).alias("at"))
        rows = one if rows is None else rows.union(one)
    first = rows.groupBy(key).agg(F.min("at").alias("at")).orderBy("at", key).limit(n)
    return first.select(key, F.row_number().over(Window.orderBy("at", key)).alias("place"))


def active_maintainers(packages: DataFrame, people: DataFrame, key: str = "package_id") -> DataFrame:
    """Packages with their sorted distinct active users; those that have none keep an empty list."""
    active = people.filter(F.col("removed_at").isNull()).groupBy(key).agg(F.sort_array(F.collect_set("user")).alias("users"))
    return packages.join(active, key, "left").withColumn("users", F.coalesce("users", F.array().cast("array<string>")))


def first_filled(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column) of all keys: the left one's value unless it is empty, then the right one's."""
    a = left.select(key, F.nullif(column, F.lit("")).alias("__a"))
    b = right.select(key, F.nullif(column, F.lit("")).alias("__b"))
    return a.join(b, key, "full").select(key, F.coalesce("__a", "__b").alias(column))
