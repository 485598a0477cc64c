"""Similarities of given pairs, and evaluation of predictions against a truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewarden.functions.similarity import cosine, greatest_number, six
from namewarden.operators.evaluate import auc, confusion, roc, sweep


def similarity(pairs: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) with the six similarities, the greatest of them, and the vectors' cosine where ``catalog`` has both names' embeddings.

    ``catalog`` has (package_name, embedding), a row for each name. Pairs stay
    as they are, repeats and other columns included; a null name's
    similarities are null.
    """
    measures = six(F.col("a"), F.col("b"))
    out = pairs.withColumns(measures)
    out = out.withColumn("similarity", greatest_number(*(F.col(c).cast("double") for c in measures)))
    if catalog is None:
        return out.withColumn("vector_similarity", F.lit(None).cast("double"))
    side = lambda c: catalog.filter(F.col("embedding").isNotNull()).select(F.col("package_name").alias(c), F.col("embedding").alias(f"__{c}"))
    out = out.join(side("a"), "a", "left").join(side("b"), "b", "left")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return out.withColumn("vector_similarity", F.when(both, cosine(F.col("__a"), F.col("__b")))).drop("__a", "__b")


def evaluate(truth: DataFrame, predictions: DataFrame, mode: str = "counts", key: str = "key", threshold: float = 0.5) -> DataFrame:
    """How predictions (key, score) agree with a truth (key, label): by ``mode``

    counts: confusion and ratios at ``threshold``; a key without a prediction counts as one under it.
    sweep: the same at every hundredth. curve: true and false positive rates at every score. area: under that curve.

    The last three are of keys on both sides. Null labels and scores count as
    unknown, which leaves them out, but for counts, where a null score is under
    any threshold. Keys have one row on each side.
    """
    known = truth.filter(F.col(key).isNotNull() & F.col("label").isNotNull()).select(key, F.col("label").cast("boolean").alias("label"))
    said = predictions.select(key, F.col("score").cast("double").alias("score"))
    if mode == "counts":
        both = known.join(said, key, "left").select("label", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("said"))
        return confusion(both, "label", "said")
    both = known.join(said.filter(F.col("score").isNotNull()), key)
    if mode == "sweep":
        return sweep(both, "label", "score")
    if mode == "curve":
        return roc(both, "label", "score")
    if mode == "area":
        return auc(both, "label", "score")
    raise ValueError(f"no mode {mode}: counts, sweep, curve or area")
