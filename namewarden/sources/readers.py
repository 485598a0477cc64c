"""Sources: package dumps, lists, pairs, feeds, tool output, tables of databases."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewarden.functions.names import registry_named, registry_of

POPULAR_SCHEMA = "package_name string, popularity double"


def csv(spark: SparkSession, path: str, schema: str | None = None, separator: str = ",") -> DataFrame:
    """A CSV with a header; without a schema every column is a string."""
    reader = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def names(df: DataFrame) -> DataFrame:
    """``df`` with package_name: of that column, else group_id:artifact_id, else context_id."""
    if "package_name" in df.columns:
        return df
    if {"group_id", "artifact_id"} <= set(df.columns):
        return df.withColumn("package_name", F.concat_ws(":", "group_id", "artifact_id"))
    if "context_id" in df.columns:
        return df.withColumn("package_name", F.col("context_id"))
    raise ValueError("no column of names: package_name, group_id and artifact_id, or context_id")


def distinct_names(df: DataFrame) -> DataFrame:
    """The distinct names of rows without any null."""
    return names(df.na.drop()).select("package_name").distinct()


def catalog_names(df: DataFrame) -> DataFrame:
    """The distinct names of an embedding table or of any dump."""
    return names(df).select("package_name").filter(F.col("package_name").isNotNull()).distinct()


def first_columns(spark: SparkSession, folder: str) -> DataFrame:
    """(package_name): the distinct first columns of all CSV files in a folder, headers left out."""
    raw = spark.read.option("header", True).csv(folder)
    return raw.select(F.col(raw.columns[0]).alias("package_name")).filter("package_name is not null").distinct()


def short_names(df: DataFrame, under: int = 10, most: int = 1000) -> DataFrame:
    """At most so many names of fewer characters, the first by name."""
    return df.filter(F.length("package_name") < under).orderBy("package_name").limit(most)


def dumps(tables: dict[str, DataFrame]) -> DataFrame:
    """(package_name, Ecosystem) of the dumps there are."""
    out = None
    for registry, df in tables.items():
        one = names(df).select("package_name", F.lit(registry).alias("Ecosystem"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no dump")
    return out


def dump_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(package_name, Ecosystem) of CSV dumps, the ecosystem from the file's name."""
    one = [names(csv(spark, p)).select("package_name", registry_named(F.lit(p.rsplit("/", 1)[-1])).alias("Ecosystem")) for p in paths]
    out = one[0]
    for df in one[1:]:
        out = out.unionByName(df)
    return out


def popular_list(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, POPULAR_SCHEMA).orderBy(F.col("popularity").desc())


def positive_pairs(df: DataFrame) -> DataFrame:
    """Pairs with both names and a source that aren't marked as made up, under either spelling of that column."""
    mark = next((F.col(c) for c in ("hallucinated", "hallucianated") if c in df.columns), F.lit(None).cast("string"))
    filled = [F.coalesce(F.length(F.trim(c)) > 0, F.lit(False)) for c in ("typosquat_pkg", "legitimate_pkg", "source")]
    made_up = F.lower(F.trim(F.coalesce(mark, F.lit("")))).isin("yes", "true", "1")
    return df.filter(filled[0] & filled[1] & filled[2] & ~made_up)


def not_unknown(df: DataFrame, column: str = "confusion") -> DataFrame:
    return df.filter(F.coalesce(F.upper(F.trim(column)) != "UNK", F.lit(True)))


def json_lists(path: str) -> dict[str, list[str]]:
    """A small JSON object of lists by registry (commands, trusted namespaces), keys normalised."""
    from namewarden.config import ALIASES

    with open(path, encoding="utf-8") as f:
        return {ALIASES.get(k.lower(), k.lower()): list(v) for k, v in json.load(f).items()}


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A database's table; by ranges of a numeric or date ``key``, whose bounds are asked for first, in ``parts`` tasks.

    Without a key one task reads all. Filters and columns go to the database.
    """
    read = lambda t, **more: spark.read.format("jdbc").options(url=url, dbtable=t, **options, **more).load()
    if key is None:
        return read(table)
    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = read(f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}) bounds").first()
    if low is None:
        return read(table)
    return read(table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))


def feed_artifacts(df: DataFrame, column: str = "artifact") -> DataFrame:
    """Threat feed rows with type, namespace and name of their JSON."""
    kind = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "namespace", "name")])
    parsed = F.from_json(column, kind)
    return df.withColumns({"type": registry_of(parsed["type"]), "namespace": parsed["namespace"], "name": parsed["name"]})


def tool_line(line: Column) -> Column:
    """struct(target, input, category, seconds) of a line ('target', 'input'): {'input': 'class'}, h:mm:ss; null if it isn't one."""
    form = r"^\('([^']*)', '([^']*)'\): \{(?:'[^']*': '([^']*)')?[^}]*\}, (\d+):(\d+):([\d.]+)"
    g = lambda i: F.regexp_extract(line, form, i)
    seconds = F.try_to_number(g(4), F.lit("999999")).cast("double") * 3600 + F.try_to_number(g(5), F.lit("99")).cast("double") * 60 + g(6).cast("double")
    made = F.struct(g(1).alias("target"), g(2).alias("input"), F.nullif(g(3), F.lit("")).alias("category"), seconds.alias("seconds"))
    return F.when(line.rlike(form), made)


def squat_line(line: Column) -> Column:
    """struct(package, reasons) of a log line that tells of a potential squat; null otherwise."""
    form = r"INFO - (\S+) package exists\. Potential squat\. \[(.*)\]"
    return F.when(line.rlike(form), F.struct(F.regexp_extract(line, form, 1).alias("package"), F.regexp_extract(line, form, 2).alias("reasons")))


def help_commands(text: str) -> list[str]:
    """The subcommands that a tool's help names: lists under a heading of commands, comma-separated or one on a line."""
    import re

    found: list[str] = []
    inside = False
    for line in text.splitlines():
        if re.match(r"^\s*(all |available |the )?[\w ]*commands( are)?:?\s*$", line, re.IGNORECASE):
            inside = True
        elif inside and line.strip() and not line[0].isspace():
            inside = False
        elif inside and "," in line:
            found += [w for w in re.split(r"[,\s]+", line.strip()) if re.fullmatch(r"[a-z][\w-]*", w)]
        elif inside and (m := re.match(r"\s+([a-z][\w-]*)(\s{2,}|\t|$)", line)):
            found.append(m[1])
    return list(dict.fromkeys(found))


def releases(doc: Column, registry: str) -> Column:
    """array of struct(version, time) from a registry's JSON about a package."""
    if registry == "npm":
        times = F.from_json(F.get_json_object(doc, "$.time"), "map<string,string>")
        return F.filter(F.transform(F.map_entries(times), lambda e: F.struct(e["key"].alias("version"), e["value"].alias("time"))), lambda e: ~e["version"].isin("created", "modified"))
    if registry == "pypi":
        uploads = F.from_json(F.get_json_object(doc, "$.releases"), "map<string,array<struct<upload_time:string>>>")
        return F.filter(F.transform(F.map_entries(uploads), lambda e: F.struct(e["key"].alias("version"), F.array_min(F.transform(e["value"], lambda u: u["upload_time"])).alias("time"))), lambda e: e["time"].isNotNull())
    rows = F.from_json(doc, "array<struct<number:string,created_at:string>>")
    return F.transform(rows, lambda r: F.struct(r["number"].alias("version"), r["created_at"].alias("time")))
