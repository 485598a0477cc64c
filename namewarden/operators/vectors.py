"""Vectors of names: pooling of words, of parts, hashed character n-grams, quantisation, projection."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewarden.functions.names import embedding_parts, tokens_served
from namewarden.operators.durable import join_split


def pooled_texts(parts: DataFrame, keys: list[str], words: DataFrame, dim: int) -> DataFrame:
    """(*keys, embedding): the mean of the vectors of a row's ``words``, repeats counted and unknown ones as zeros; zeros for no words.

    ``words`` has a row (word, vector) for each known word; rows of equal keys are one.
    """
    zeros = F.array_repeat(F.lit(0.0), dim)
    each = parts.select(*keys, F.explode_outer("words").alias("word"))
    found = join_split(each, words.select("word", F.col("vector").cast("array<double>").alias("vector")), "word")
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.coalesce("vector", zeros))))
    return found.groupBy(*keys).agg(mean.alias("embedding"))


def pooled(names: DataFrame, words: DataFrame, dim: int) -> DataFrame:
    """(package_name, embedding) of the distinct names: the mean of the vectors of a name's words, unknown ones as zeros."""
    parts = names.select("package_name").distinct().withColumn("words", tokens_served(F.col("package_name")))
    return pooled_texts(parts, ["package_name"], words, dim)


def three_vectors(names: DataFrame, words: DataFrame, dim: int, registry: str) -> DataFrame:
    """(package_name, embedding, author_embedding, package_embedding) of the distinct names of a registry.

    Names of maven, golang and hf have vectors of their author's (group's) and
    their package's (artifact's) part beside that of the whole; others have
    nulls. All three are pooled in one pass over the words.
    """
    every = names.select("package_name").filter("package_name is not null").distinct()
    kinds = ["whole"]
    parts = F.array(F.struct(F.lit("whole").alias("kind"), F.col("package_name").alias("text")))
    if registry in ("maven", "golang", "hf"):
        split = embedding_parts(F.col("package_name"), F.lit(registry))
        kinds += ["author", "package"]
        parts = F.concat(parts, F.array(*(F.struct(F.lit(k).alias("kind"), split[k].alias("text")) for k in kinds[1:])))
    rows = every.select("package_name", F.explode(parts).alias("x")).select("package_name", "x.kind", tokens_served(F.col("x.text")).alias("words"))
    found = pooled_texts(rows, ["package_name", "kind"], words, dim).groupBy("package_name").pivot("kind", kinds).agg(F.first("embedding"))
    missing = F.lit(None).cast("array<double>")
    return found.select("package_name", F.col("whole").alias("embedding"), *(F.col(k).alias(f"{k}_embedding") if k in kinds else missing.alias(f"{k}_embedding") for k in ("author", "package")))


def hashed_vector(name: str, dim: int = 64, least: int = 2, most: int = 5) -> np.ndarray:
    """The sum of signed hash directions of a name's padded character n-grams, of length 1; zeros for an empty name."""
    out = np.zeros(dim, np.float32)
    padded = f"<{name.lower()}>"
    for n in range(least, most + 1):
        for i in range(len(padded) - n + 1 if name else 0):
            h = zlib.crc32(padded[i : i + n].encode())
            out[h % dim] += 1 if h >> 31 else -1
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def hashed(names: DataFrame, column: str = "package_name", out: str = "embedding", dim: int = 64) -> DataFrame:
    """Names with vectors from their characters; a stand-in for a trained subword model, its numbers aren't comparable."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hashed_vector(x or "", dim))

    return names.withColumn(out, embed(column))


def parsed(text: Column) -> Column:
    """The vector that a text like [0.1, NaN, -2] tells; null if it tells none."""
    return F.from_json(text, "array<double>")


def written(vector: Column) -> Column:
    """A vector as a text that ``parsed`` reads."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ",", "null"), F.lit("]"))


def int8_scale(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: the greatest absolute component of all vectors / 127."""
    return vectors.agg((F.max(F.array_max(F.transform(column, lambda x: F.abs(x.cast("double"))))) / 127).alias("scale"))


def quantised(column: Column, scale: Column) -> Column:
    """Components / scale rounded half to even, as bytes; zeros at scale 0."""
    return F.transform(column, lambda x: F.when(scale > 0, F.bround(x.cast("double") / scale)).otherwise(0).cast("tinyint"))


def dequantised(column: Column, scale: Column) -> Column:
    return F.transform(column, lambda x: x * scale)


def halved(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors rounded to half precision."""

    @F.pandas_udf("array<float>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32))

    return vectors.withColumn(column, cut(column))


def sampled_negatives(names: DataFrame, positives: DataFrame, limit: int, seed: int = 42, trials: int = 50_000) -> DataFrame:
    """(a, b): pairs of distinct names, positives in either order left out, edit ratio at most 0.2, in a seeded order.

    Each name is paired with the names at a few seeded places, so that about
    ``trials`` pairs are tried without comparing all.
    """
    from namewarden.functions.similarity import edit_ratio
    from namewarden.operators.durable import cut, running

    listed = names.select(F.col("package_name").alias("a")).distinct()
    listed = cut(running(listed, [], [F.col("a")], {"i": F.lit(1)}))
    n = max(1, listed.count())
    tries = max(1, min(n, -(-trials // n)))
    key = lambda *x: F.md5(F.concat_ws(":", F.lit(seed), *x))
    place = F.pmod(F.conv(F.substring(key("a", "t"), 1, 8), 16, 10).cast("long"), F.lit(n))
    tried = listed.select("a", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("t")).withColumn("i", place)
    pairs = tried.join(listed.select(F.col("a").alias("b"), "i"), "i").filter("a <> b").select("a", "b").distinct()
    known = positives.select(F.col("a").alias("x"), F.col("b").alias("y"))
    known = known.union(known.select("y", "x")).distinct()
    pairs = pairs.join(known, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")
    return pairs.filter(edit_ratio(F.col("a"), F.col("b")) <= 0.2).orderBy(key("a", "b"), "a", "b").limit(limit)


#: Most components of vectors that are projected: their covariances lie on the driver.
MOST_COMPONENTS = 4096


def projected(vectors: DataFrame, id_col: str, vec_col: str, components: int = 2) -> DataFrame:
    """(id, place): vectors less their mean, on their ``components`` directions of most variance.

    Tasks add up their vectors and the products of these; the sums, a row for
    each component, give the covariances. A direction's sign is such that its
    largest component is positive. Vectors that are null, not finite or of
    other lengths than most have are left out; directions of no variance give 0.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").limit(1).collect()
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.array().cast("array<double>").alias("place"))
    n, dim = sizes[0].n, sizes[0].dim
    if dim > MOST_COMPONENTS:
        raise ValueError(f"vectors of over {MOST_COMPONENTS} components")
    rows = rows.filter(F.size("v") == dim)

    def add_up(frames):
        total, products = np.zeros(dim), np.zeros((dim, dim))
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_list())
                total += x.sum(axis=0)
                products += x.T @ x
        yield pd.DataFrame({"row": range(dim + 1), "x": [*products, total]})

    sums = rows.select("v").mapInPandas(add_up, "row int, x array<double>").groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("x")).orderBy("row").toPandas()
    every = np.stack(sums["x"].to_list())
    mean = every[-1] / n
    _, turn = np.linalg.eigh(every[:-1] / n - np.outer(mean, mean))
    turn = turn[:, ::-1][:, :components]
    turn *= np.where(turn[np.abs(turn).argmax(axis=0), np.arange(turn.shape[1])] < 0, -1, 1)

    def place(frames):
        for f in frames:
            if len(f):
                yield f[["id"]].assign(place=list((np.stack(f["v"].to_list()) - mean) @ turn))

    from pyspark.sql import types as T

    spec = T.StructType([rows.schema["id"], T.StructField("place", T.ArrayType(T.DoubleType()))])
    return rows.mapInPandas(place, spec).withColumnRenamed("id", id_col)
