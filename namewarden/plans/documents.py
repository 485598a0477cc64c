"""Documents of requested packages, from tables that lie apart by registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requested(packages: DataFrame, requests: DataFrame) -> DataFrame:
    """The rows of ``packages`` that (registry, package_name) ask for, case aside; of partitions by registry only those that are asked for are read."""
    asked = requests.select("registry", F.lower("package_name").alias("__name")).filter(F.col("__name").isNotNull()).distinct()
    rows = packages.withColumn("__name", F.lower("package_name"))
    return rows.join(asked, ["registry", "__name"], "left_semi").drop("__name")


def maven_descriptions(packages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(package_name, description) of packages that have an artifact of their id."""
    return packages.join(artifacts.select("id", F.col("raw_index").alias("description")), "id").select(F.concat_ws(":", "group_id", "artifact_id").alias("package_name"), "description")


def nuget_documents(packages: DataFrame, nuget: DataFrame) -> DataFrame:
    """(package_name, doc, description, summary, owners) of the packages of nuget, whose partition alone is read; nulls where ``nuget`` lacks one."""
    own = packages.filter(F.col("registry") == "nuget").select("package_name", "doc")
    return own.join(nuget.select("package_name", "description", "summary", "owners"), "package_name", "left")
