"""Vectors of names from their words' character n-grams, trained on the names themselves.

A unit is a word or one of its n-grams. Units are counted with the words that
stand beside theirs in a name, and with their own word; counts are weighted by
positive mutual information, and the matrix of units and hashed words is
factorised by a randomised singular value decomposition: tasks multiply their
units' rows with a narrow matrix and add up the results, the driver holds
matrices of a fixed size only. A word's vector is the mean of its units', so a
word that wasn't trained on has one too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewarden.functions.names import tokens_trained
from namewarden.operators.durable import cut, join_split

#: Components; letters of the shortest and longest n-gram; words on either side; hashed columns; extra columns and rounds of the decomposition.
DIM, LEAST, MOST, WINDOW, COLUMNS, EXTRA, ROUNDS = 64, 2, 5, 5, 8192, 16, 3
#: Cells that a task multiplies at once.
CELLS = 200_000


def units(word: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The distinct n-grams of a word between < and >, and = before the whole word."""
    padded = F.concat(F.lit("<"), word, F.lit(">"))
    n = F.length(padded)
    grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("="), word)), *(grams(k) for k in range(least, most + 1))))


def counts(names: DataFrame, least: int = LEAST, most: int = MOST, window: int = WINDOW, columns: int = COLUMNS) -> DataFrame:
    """(unit, col, n): how often a unit's word stands within ``window`` words of one of a column, itself included."""
    words = names.select("package_name").distinct().withColumn("words", tokens_trained(F.col("package_name")))
    centre = words.select("words", F.posexplode("words").alias("at", "word"))
    beside = F.slice("words", F.greatest(F.col("at") + 1 - window, F.lit(1)), F.least(F.col("at"), F.lit(window)) + 1 + window)
    pairs = centre.select("word", F.explode(beside).alias("other")).groupBy("word", "other").agg(F.count(F.lit(1)).alias("n"))
    cells = pairs.select(F.explode(units(F.col("word"), least, most)).alias("unit"), F.pmod(F.xxhash64("other"), F.lit(columns)).cast("int").alias("col"), "n")
    return cells.groupBy("unit", "col").agg(F.sum("n").alias("n"))


class Weighted:
    """Rows of (unit, n, cols, counts) as mutual information, in stretches of cells."""

    def __init__(self, of_column: np.ndarray) -> None:
        self.total = of_column.sum()
        self.logs = np.log(np.maximum(of_column, 1e-300))

    def stretches(self, f: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, where each one's cells begin, columns, weights)."""
        sizes = f["cols"].map(len).to_numpy()
        part = np.cumsum(sizes) // CELLS
        for p in np.unique(part):
            rows = f[part == p]
            n = sizes[part == p]
            cols = np.concatenate(rows["cols"].to_list()).astype(np.int64)
            x = np.log(np.concatenate(rows["counts"].to_list()).astype(float)) + np.log(self.total) - np.repeat(np.log(rows["n"].to_numpy(float)), n) - self.logs[cols]
            yield rows, np.cumsum(n) - n, cols, np.maximum(x, 0)


def _summed(rows: DataFrame, by: str) -> pd.DataFrame:
    """Arrays x added up by a key of a bounded number of values."""
    added = rows.groupBy(by).agg(vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("x"))
    return added.toPandas()


def train(names: DataFrame, dim: int = DIM, seed: int = 42, least: int = LEAST, most: int = MOST, window: int = WINDOW, columns: int = COLUMNS, rounds: int = ROUNDS) -> DataFrame:
    """(unit, vector) of all units of the distinct names, the same for the same ``seed`` but for rounding.

    Names without words have no units; with none at all the table is empty.
    """
    cells = cut(counts(names.filter("package_name is not null"), least, most, window, columns))
    found = cells.groupBy("col").agg(F.sum("n").alias("n")).toPandas()  # ``columns`` rows at most
    of_column = np.zeros(columns)
    of_column[found["col"]] = found["n"]
    weighted = Weighted(of_column)
    rows = cut(cells.groupBy("unit").agg(F.sum("n").alias("n"), F.collect_list(F.struct("col", "n")).alias("c")).select("unit", "n", F.transform("c", lambda c: c["col"]).alias("cols"), F.transform("c", lambda c: c["n"]).alias("counts")))
    if not len(found):
        return rows.select("unit", F.array().cast("array<double>").alias("vector"))
    wide = min(columns, dim + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, wide)))[0]

    def times(f: pd.DataFrame, matrix: np.ndarray) -> Iterator[tuple]:
        for part, starts, cols, x in weighted.stretches(f):
            yield part, starts, cols, x, np.add.reduceat(x[:, None] * matrix[cols], starts, axis=0)

    for _ in range(rounds):

        def back(frames: Iterator[pd.DataFrame], basis: np.ndarray = basis) -> Iterator[pd.DataFrame]:
            """The transposed matrix times the matrix times the basis, a task's share."""
            out = np.zeros((columns, wide))
            for f in frames:
                for _, starts, cols, x, y in times(f, basis) if len(f) else ():
                    each = np.repeat(np.arange(len(starts)), np.diff([*starts, len(cols)]))
                    for j in range(wide):
                        out[:, j] += np.bincount(cols, x * y[each, j], columns)
            used = np.flatnonzero(np.abs(out).sum(axis=1))
            if len(used):
                yield pd.DataFrame({"col": used, "x": list(out[used])})

        got = _summed(rows.mapInPandas(back, "col int, x array<double>"), "col")
        image = np.zeros((columns, wide))
        if len(got):
            image[got["col"]] = np.stack(got["x"].to_list())
        basis = np.linalg.qr(image)[0]

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((wide, wide))
        for f in frames:
            for *_, y in times(f, basis) if len(f) else ():
                out += y.T @ y
        yield pd.DataFrame({"one": [0], "x": [out.ravel()]})

    squared = _summed(rows.mapInPandas(gram, "one int, x array<double>"), "one")["x"].iloc[0]
    squared = np.array(squared).reshape(wide, wide)
    value, turn = np.linalg.eigh(squared)
    value, turn = np.maximum(value[::-1][:dim], 0), turn[:, ::-1][:, :dim]
    turn *= np.where(turn[np.abs(turn).argmax(axis=0), np.arange(turn.shape[1])] < 0, -1, 1)
    # units' left singular vectors times the root of the values
    project = basis @ turn * np.where(value > 1e-12 * value.max(initial=0), np.maximum(value, 1e-300) ** -0.25, 0)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, *_, y in times(f, project) if len(f) else ():
                yield pd.DataFrame({"unit": part["unit"], "vector": list(y)})

    return cut(rows.mapInPandas(place, "unit string, vector array<double>"))


def word_vectors(words: DataFrame, trained: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(word, vector) of the distinct words that have a trained unit: the mean of these."""
    parts = words.select("word").filter("word <> ''").distinct().withColumn("unit", F.explode(units(F.col("word"), least, most)))
    found = join_split(parts, trained, "unit", "inner")
    return found.groupBy("word").agg(vector_to_array(Summarizer.mean(array_to_vector("vector"))).alias("vector"))


def name_vectors(names: DataFrame, trained: DataFrame, dim: int = DIM, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(package_name, embedding) of the distinct names: the mean of the words' vectors; of a name without words its own as one, of length 1.

    A word none of whose units is known counts as zeros.
    """
    from namewarden.operators.vectors import pooled_texts

    every = names.select("package_name").filter("package_name is not null").distinct().withColumn("words", tokens_trained(F.col("package_name")))
    bare = F.size("words") == 0
    parts = every.select("package_name", F.when(bare, F.array("package_name")).otherwise(F.col("words")).alias("words"), bare.alias("bare"))
    found = word_vectors(parts.select(F.explode("words").alias("word")), trained, least, most)
    out = pooled_texts(parts.select("package_name", "bare", "words"), ["package_name", "bare"], found, dim)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return out.select("package_name", F.when(F.col("bare") & (norm > 0), F.transform("embedding", lambda x: x / norm)).otherwise(F.col("embedding")).alias("embedding"))
