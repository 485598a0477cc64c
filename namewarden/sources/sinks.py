"""Sinks: lists, results and catalogs as files; an overwrite goes to a new folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_catalog(df: DataFrame, path: str) -> None:
    """Parquet by registry, so that a query of one registry reads no other."""
    df.write.mode("overwrite").partitionBy("registry").parquet(path)


def save_table(df: DataFrame, name: str, path: str | None = None, by: str | None = "registry") -> None:
    """A table of the session's catalog, in place of one of that name; its files at ``path``, apart by a column."""
    writer = df.write.mode("overwrite")
    writer = writer.option("path", path) if path else writer
    (writer.partitionBy(by) if by else writer).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Takes a table out of the catalog, if it is there; files at a path of its own stay."""
    spark.sql("DROP TABLE IF EXISTS " + ".".join("`" + part.replace("`", "``") + "`" for part in name.split(".")))
