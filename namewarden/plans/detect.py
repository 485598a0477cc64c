"""Detection end to end: allowlist, neighbours, metadata, judge, risk score, the first that isn't benign."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewarden.config import LEAST_SIMILARITY, REGISTRIES, TRUSTED_NAMESPACES
from namewarden.functions.attacks import attack_class
from namewarden.functions.names import maintainers, namespace
from namewarden.operators.benignity import active, comprehensive, judged, no_judge, overlapping, verified
from namewarden.operators.neighbors import by_group, commands, flat, scored, valid
from namewarden.operators.popular import far_more_popular

HIERARCHIES = {"maven", "golang", "hf"}


def neighbours(queries: DataFrame, popular: DataFrame, registry: str, known_commands: Sequence[str] = (), least: float = LEAST_SIMILARITY) -> DataFrame:
    """Ranked neighbours of names in one registry; command squats are among them, with rank 0. An unknown registry has none."""
    if registry not in REGISTRIES:
        queries = queries.filter(F.lit(False))
    if registry in HIERARCHIES:
        pairs = by_group(queries, popular, registry)
    else:
        pairs = flat(queries, popular, vector_over=0.8 if "embedding" in queries.columns and "embedding" in popular.columns else None)
    found = scored(pairs, popular, registry, least).select("query", "package_name", "overall", "popularity", "rank", F.lit(None).cast("string").alias("command"))
    if not known_commands:
        return found
    squats = commands(queries, known_commands).select("query", F.col("command").alias("package_name"), F.lit(1.0).alias("overall"), F.lit(0.0).alias("popularity"), F.lit(0).alias("rank"), "command")
    return found.unionByName(squats)


def verify(pairs: DataFrame, documents: DataFrame, as_of: str, judge: Callable[[pd.DataFrame], pd.DataFrame] = no_judge, registry: str = "npm") -> DataFrame:
    """Pairs (query, package_name) with both documents (name, doc): metadata facts, the judge's flags and the risk score.

    Pairs of which a document is missing have metadata_missing and no verdict.
    """
    of = lambda side: documents.select(F.col("name").alias(f"{side}_name"), F.col("doc").alias(f"{side}_doc"))
    df = pairs.join(of("own"), F.col("query") == F.col("own_name"), "left").join(of("target"), F.col("package_name") == F.col("target_name"), "left").drop("own_name", "target_name")
    df = df.withColumn("metadata_missing", F.col("own_doc").isNull() | F.col("target_doc").isNull())
    get = lambda p: F.get_json_object("own_doc", p)
    people = lambda doc: maintainers(F.col(doc), F.lit(registry))
    own = people("own_doc")
    keys = F.coalesce(F.json_object_keys("own_doc"), F.array().cast("array<string>"))
    df = df.withColumns({
        "overlapped_maintainers": overlapping(own, people("target_doc")),
        "comprehensive_metadata": F.coalesce(comprehensive(get("$.license"), own, get("$.repository_url"), get("$.webpage"), F.array_contains(keys, "description"), F.array_contains(keys, "readme")), F.lit(False)),
        "active_development": active(get("$.pushed_at"), F.try_to_number(get("$.versions_count"), F.lit("999999")).cast("int"), F.lit(as_of).cast("timestamp")),
    })
    out = verified(judged(df, judge))
    return out.withColumn("is_false_positive", F.when(~F.col("metadata_missing"), F.col("is_false_positive")))


def untrusted(queries: DataFrame, registry: str, trusted: Sequence[str] | None = None) -> DataFrame:
    """Queries that aren't in a trusted namespace of the registry."""
    trusted = TRUSTED_NAMESPACES.get(registry, []) if trusted is None else trusted
    space = namespace(F.col("package_name"), F.lit(registry))
    return queries.filter(~F.coalesce(space.isin(list(trusted)), F.lit(False)))


def detect(queries: DataFrame, popular: DataFrame, documents: DataFrame, registry: str, as_of: str, judge: Callable[[pd.DataFrame], pd.DataFrame] = no_judge, known_commands: Sequence[str] = (), trusted: Sequence[str] | None = None) -> DataFrame:
    """At most one row for a query: its first neighbour, in order, that isn't benign, and what was done to its name.

    Queries in a trusted namespace give none. A query that is popular itself is
    held against much more popular names only, and is told to be removed from
    the list.
    """
    trusted = TRUSTED_NAMESPACES.get(registry, []) if trusted is None else trusted
    space = lambda c: namespace(F.col(c), F.lit(registry))
    asked = untrusted(queries, registry, trusted)
    found = neighbours(asked, popular, registry, known_commands)
    own = asked.join(popular.select("package_name"), "package_name", "left_semi").select(F.col("package_name").alias("query"))
    found = found.join(own, "query", "left_anti").unionByName(far_more_popular(found.join(own, "query", "left_semi"), popular, registry))
    found = found.withColumns({"__a": space("query"), "__b": space("package_name")})
    kept = valid(found, registry, trusted, ("__a", "__b") if registry == "npm" else None).drop("__a", "__b")
    bad = verify(kept, documents, as_of, judge, registry).filter("is_false_positive = false")
    first = bad.groupBy("query").agg(F.min_by(F.struct("package_name", "overall", "risk_score", "risk_level", "FP_category", "explanation", "command"), "rank").alias("x")).select("query", "x.*")
    first = first.withColumn("attack_class", attack_class(F.col("query"), F.col("package_name")))
    return first.join(own.withColumn("removed_from_legit", F.lit(True)), "query", "left").withColumn("removed_from_legit", F.coalesce("removed_from_legit", F.lit(False)))


def full_scan(packages: DataFrame, popular: DataFrame, registry: str, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Neighbours of every package that isn't popular."""
    return neighbours(packages.join(popular.select("package_name"), "package_name", "left_anti"), popular, registry, least=least)
