"""Arrivals of new names against a static popular list, and windowed counts of what they hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewarden.config import NEAR_EDITS
from namewarden.operators.durable import cut, small
from namewarden.operators.edits import names_near, near
from namewarden.operators.neighbors import most_edits


def confusable(arrivals: DataFrame, popular: DataFrame, name: str = "package_name") -> DataFrame:
    """Rows of a stream with the popular names within two edits; each pair of a row once.

    Stateless on a stream, so it runs in append mode. Names of a batch are
    compared once each, however many rows have them.
    """
    listed = popular.select(F.lower(name).alias("target")).distinct()
    rows, wanted = arrivals.withColumn("__low", F.lower(name)), F.col("__low") != F.col("target")
    pairs = near(rows, listed, "__low", "target", NEAR_EDITS - 1) if arrivals.isStreaming else names_near(rows, listed, "__low", "target", NEAR_EDITS - 1)
    pairs = pairs.filter(wanted).withColumn("edits", F.levenshtein("__low", "target")).filter(F.col("edits") < most_edits(F.col("__low")))
    if not arrivals.isStreaming:
        pairs = rows.join(small(cut(pairs)), "__low")
    return pairs.drop("__low")


def counts(pairs: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, target, n) for windows of event time; rows later than the watermark are left out."""
    return pairs.withWatermark(time, late).groupBy(F.window(time, window), "target").agg(F.count(F.lit(1)).alias("n"))
