"""Learned weights of the benignity flags: logistic regression with folds, importances, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows needed to fit and to validate.
LEAST, LEAST_FOLDS = 10, 20


def assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    df = df.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("label"))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0) -> LogisticRegressionModel | None:
    """The model with an L2 penalty of 1 / (c n); None for too few rows or a single class."""
    rows = assembled(df, features, label)
    n = rows.count()
    if n < LEAST or rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(standardization=False, regParam=1 / (c * n), maxIter=100).fit(rows)


def validated(df: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 5, c: float = 1.0) -> DataFrame | None:
    """(fold, n, accuracy) over folds that keep the classes' shares; None for too few rows."""
    if df.count() < LEAST_FOLDS:
        return None
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    rows = df.withColumn("fold", F.row_number().over(order) % folds)
    out = None
    for k in range(folds):
        model = fit(rows.filter(F.col("fold") != k), features, label, c)
        if model is None:
            continue
        said = model.transform(assembled(rows.filter(F.col("fold") == k), features, label))
        one = said.agg(F.lit(k).alias("fold"), F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


def importances(model: LogisticRegressionModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, weight, importance): the mean of |weight (x - mean x)|, the linear model's Shapley values."""
    weights = [float(w) for w in model.coefficients]
    means = df.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in features)).first()
    sums = df.agg(*(F.avg(F.abs((F.col(c).cast("double") - means[c]) * w)).alias(c) for c, w in zip(features, weights)))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(w).alias("weight"), F.col(c).alias("importance")) for c, w in zip(features, weights)))
    return sums.select(F.explode(rows).alias("x")).select("x.*").orderBy(F.col("importance").desc(), "feature")


def scored(model: LogisticRegressionModel, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows with the weighted sum of their flags and the probability."""
    total = sum((F.col(c) * float(w) for c, w in zip(features, model.coefficients)), F.lit(0.0))
    out = model.transform(assembled(df, features, label))
    return out.select(*features, "label", total.alias("learned_score"), vector_to_array("probability")[1].alias("probability"))
