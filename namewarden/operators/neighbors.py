"""Confusable neighbours of names among popular names, per kind of registry.

Names within a few edits share a segment, so they are joined on those, flat
names by themselves and names of registries with namespaces within their equal
part. Vectors over a threshold are joined by angles, within that part too. No
arm compares all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewarden.config import AUTHOR_OVER, FLAT_LIMIT, GROUP_EDITS, KEPT, LEAST_SIMILARITY, NEAR_EDITS, PART_OVER, VECTOR_OVER
from namewarden.functions.edit import osa_col
from namewarden.functions.similarity import cosine, greatest_number, six, suspicious_namespace
from namewarden.operators.angles import SLACK, cosine_of, cosine_over
from namewarden.operators.edits import names_near
from namewarden.operators.popular import low_is_popular


def most_edits(name: Column) -> Column:
    """Two thirds of a name's length, whole."""
    return F.floor(2 * F.length(name) / 3)


def within_two_edits(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of rows whose lower-case names are within two edits."""
    x, y = left.select(F.lower(a).alias("__a")), right.select(F.lower(b).alias("__b"))
    pairs = names_near(x, y, "__a", "__b", NEAR_EDITS - 1)
    return left.join(pairs, F.lower(left[a]) == F.col("__a")).join(right, F.lower(right[b]) == F.col("__b")).drop("__a", "__b")


def _first_by_edits(names: DataFrame, limit: int) -> DataFrame:
    """Pairs that can be neighbours and of which under ``limit`` of the query have fewer edits; the others aren't kept whatever their vectors."""
    pairs = names.withColumn("__edits", F.levenshtein(F.lower("query"), F.lower("package_name")))
    pairs = pairs.filter((F.col("__edits") > 0) & (F.col("__edits") < most_edits(F.col("query"))))
    return pairs.withColumn("__place", F.rank().over(Window.partitionBy("query").orderBy("__edits"))).filter(F.col("__place") <= limit).drop("__edits", "__place")


def flat(queries: DataFrame, popular: DataFrame, limit: int = FLAT_LIMIT, vector_over: float | None = VECTOR_OVER) -> DataFrame:
    """(query, package_name, edits, vector_similarity, place): neighbours of names without namespaces.

    A neighbour is within two edits, or its vector's cosine is over
    ``vector_over``; either way its edits are under two thirds of the query's
    length. Close names come first by edits, then vectors, then names. Without
    ``vector_over`` vectors aren't looked at.
    """
    q = queries.select(F.col("package_name").alias("query"), *([F.col("embedding").alias("__v")] if vector_over is not None else []))
    p = popular.select("package_name", *(["embedding"] if vector_over is not None else []))
    if vector_over is not None:
        p = p.filter(F.col("embedding").isNotNull())
    names = within_two_edits(q.select("query").distinct(), p.select("package_name").distinct(), "query", "package_name")
    if vector_over is not None:
        left, right = q.select(F.col("query").alias("a"), F.col("__v").alias("v")), p.select(F.col("package_name").alias("b"), F.col("embedding").alias("v"))
        near = cosine_of(_first_by_edits(names, limit).select(F.col("query").alias("a"), F.col("package_name").alias("b")), left, right)
        pairs = cosine_over(left, right, vector_over).select("a", "b", "similarity").union(near).toDF("query", "package_name", "vector_similarity")
        pairs = pairs.groupBy("query", "package_name").agg(F.max("vector_similarity").alias("vector_similarity"))
    else:
        pairs = names.withColumn("vector_similarity", F.lit(None).cast("double"))
    pairs = pairs.withColumn("edits", F.levenshtein(F.lower("query"), F.lower("package_name")))
    pairs = pairs.filter((F.lower("query") != F.lower("package_name")) & (F.col("edits") < most_edits(F.col("query"))))
    close = F.col("edits") < NEAR_EDITS
    order = Window.partitionBy("query").orderBy(close.desc(), F.when(close, F.col("edits")).asc_nulls_last(), F.col("vector_similarity").desc_nulls_last(), "package_name")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query", "package_name", "edits", "vector_similarity", "place")


def by_group(queries: DataFrame, popular: DataFrame, kind: str) -> DataFrame:
    """(query, package_name, edits, author_similarity, package_similarity, place) for maven, golang or hf names.

    Equal in one part (artifact; third of a path; model), unequal in another
    (group; second of a path; author), which is under four edits away or whose
    vector's cosine is over 0.9 while the equal part's is over 0.99. But for
    golang the edits are also under two thirds of that part's length; maven
    drops neighbours of the same first two labels.
    """
    delimiter, same, other, over = {"maven": (":", 2, 1, True), "golang": ("/", 3, 2, False), "hf": ("/", 2, 1, True)}[kind]
    part = lambda c, n: F.split_part(c, F.lit(delimiter), F.lit(n))
    side = lambda df, x: df.select(*(F.col(c).alias(f"{x}_{c}") for c in ("package_name", "author_embedding", "package_embedding") if c in df.columns), F.lower(part(F.col("package_name"), same)).alias("__same"), F.lower(part(F.col("package_name"), other)).alias(f"{x}_other"), part(F.col("package_name"), other).alias(f"{x}_raw"))
    q, p = side(queries, "q").filter("__same <> ''"), side(popular, "p").filter("__same <> ''")
    own, their = (["q_package_name", "q_other"], ["p_package_name", "p_other"])
    near = names_near(q, p, "q_other", "p_other", GROUP_EDITS - 1, ["__same"])
    found = q.select("__same", *own).distinct().join(near, ["__same", "q_other"]).join(p.select("__same", *their).distinct(), ["__same", "p_other"]).select(own[0], their[0])
    vectors = "author_embedding" in queries.columns and "author_embedding" in popular.columns and "package_embedding" in queries.columns and "package_embedding" in popular.columns
    if vectors:
        given = lambda df, x, c: df.select("__same", F.col(f"{x}_package_name").alias(c), F.col(f"{x}_author_embedding").alias("v"), F.col(f"{x}_package_embedding").alias("w"))
        by_vector = cosine_over(given(q, "q", "a"), given(p, "p", "b"), AUTHOR_OVER - SLACK, ["__same"], also=PART_OVER - SLACK)  # the exact limits are below
        found = found.union(by_vector.select("a", "b"))
    pairs = q.join(found.distinct(), own[0]).join(p.drop("__same"), their[0])
    pairs = pairs.filter((F.col("q_other") != F.col("p_other")) & (F.col("q_package_name") != F.col("p_package_name")))
    pairs = pairs.withColumn("edits", F.levenshtein("q_other", "p_other"))
    zero = F.lit(0.0)
    author = cosine(F.col("q_author_embedding"), F.col("p_author_embedding")) if vectors else zero
    package = cosine(F.col("q_package_embedding"), F.col("p_package_embedding")) if vectors else zero
    pairs = pairs.withColumns({"author_similarity": author, "package_similarity": package})
    keep = ((F.col("author_similarity") > AUTHOR_OVER) & (F.col("package_similarity") > PART_OVER)) | (F.col("edits") < GROUP_EDITS)
    if over:
        keep = keep & (F.col("edits") < most_edits(F.col("q_other")))
    if kind == "maven":
        domain = lambda c: F.array_join(F.slice(F.split(c, r"\."), 1, 2), ".")
        keep = keep & (domain(F.col("q_raw")) != domain(F.col("p_raw")))
    order = Window.partitionBy("q_package_name").orderBy("edits", F.col("package_similarity").desc(), F.col("author_similarity").desc(), "p_package_name")
    pairs = pairs.filter(keep).withColumn("place", F.row_number().over(order))
    return pairs.select(F.col("q_package_name").alias("query"), F.col("p_package_name").alias("package_name"), "edits", "author_similarity", "package_similarity", "place")


def commands(queries: DataFrame, known: Sequence[str], measure: str = "osa") -> DataFrame:
    """(query, command): the first command, in list order, less than two edits from a name."""
    low = F.lower("package_name")
    listed = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(known)))
    rows = queries.select("package_name", F.explode(listed).alias("x")).filter(F.levenshtein(low, F.lower("x.c"), 2) >= 0)
    d = F.levenshtein(low, F.lower("x.c")) if measure == "lev" else osa_col(low, F.lower("x.c"))
    return rows.filter(d < 2).groupBy(F.col("package_name").alias("query")).agg(F.min_by("x.c", "x.i").alias("command"))


def scored(pairs: DataFrame, popular: DataFrame, registry: str, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Pairs with the six similarities, overall (their and the vector's greatest), popularity (0: unknown) and rank, if overall is ``least`` or more."""
    vector = "author_similarity" if "author_similarity" in pairs.columns else "vector_similarity"
    measures = six(F.col("query"), F.col("package_name"))
    df = pairs.withColumns(measures)
    df = df.withColumn("overall", greatest_number(*(F.col(c).cast("double") for c in (*measures, vector)))).filter(F.col("overall") >= least)
    listed = popular.groupBy("package_name").agg(F.max("popularity").alias("popularity"))
    df = df.join(listed, "package_name", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0.0)))
    by = F.col("popularity").asc() if low_is_popular(registry) else F.col("popularity").desc()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("overall").desc(), by, "package_name")))


def valid(neighbours: DataFrame, registry: str, trusted: Sequence[str] = (), spaces: tuple[str, str] | None = None, kept: int = KEPT) -> DataFrame:
    """The first neighbours by rank of at least three characters and, for npm, of suspicious namespaces (columns ``spaces``)."""
    keep = ~F.isnan("overall") & (F.length("package_name") >= 3)
    if registry == "npm" and spaces:
        keep = keep & suspicious_namespace(F.col(spaces[0]), F.col(spaces[1]), F.array(*map(F.lit, trusted)).cast("array<string>"))
    order = Window.partitionBy("query").orderBy("rank")
    return neighbours.filter(keep).withColumn("choice", F.row_number().over(order)).filter(F.col("choice") <= kept)
