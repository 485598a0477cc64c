"""Releases of an original and of its imitation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewarden.functions.times import parsed_time


def first_uploads(files: DataFrame, package: str, version: str, time: str) -> DataFrame:
    """(package, version, time): the earliest upload of each version."""
    return files.groupBy(package, version).agg(F.min(time).alias(time))


def before_first_bad(releases: DataFrame, bad: DataFrame, key: str, time: str) -> DataFrame:
    """(key, first_bad, earlier): how many releases precede the first bad one; keys without a bad one are left out.

    Times that are texts may have any of the forms that ``parsed_time`` knows;
    others count as unknown.
    """
    timed = lambda df: df.withColumn(time, parsed_time(F.col(time))) if df.schema[time].dataType.simpleString() == "string" else df
    releases, bad = timed(releases), timed(bad).filter(F.col(time).isNotNull())
    first = bad.groupBy(key).agg(F.min(time).alias("first_bad"))
    return first.join(releases.select(key, time), key, "left").groupBy(key, "first_bad").agg(F.count_if(F.col(time) < F.col("first_bad")).alias("earlier"))
