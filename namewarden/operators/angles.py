"""Cosine range joins: all pairs of vectors over a threshold, without comparing all.

Angles between vectors are a metric. Vectors of the right side lie in the cell
of the reference vector that they are nearest to; one of the left goes to the
cells only that can hold a vector within the angle: those whose ring of angles
it can reach, and whose reference isn't farther than its own nearest by over
twice the angle. Cells are joined block against block as matrix products; a
row of the left is sent once for each block of the cells that it may match.

Joins within equal keys compare small groups directly; only groups of many
pairs are cut into cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewarden.functions.similarity import cosine
from namewarden.operators.durable import cut, small
from namewarden.operators.pairwise import unit

#: Most references; vectors a cell should have; rows of a block of either side; pairs of a group that are compared directly; most tasks.
REFERENCES, CELL, ROWS, DIRECT, TASKS = 512, 2048, 4096, 250_000, 20_000
#: Angles are compared with so much to spare.
SLACK = 1e-6


def usable(df: DataFrame, v: str) -> DataFrame:
    """Rows whose vectors are neither null, empty nor zero and finite, as doubles."""
    df = df.withColumn(v, F.col(v).cast("array<double>")).filter(F.size(v) > 0)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(sound & F.exists(v, lambda x: x != 0))


def angles(units: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ references.T, -1, 1))


class Cells:
    """References by dimension, and each cell's least and greatest angle."""

    def __init__(self, references: dict[int, np.ndarray], over: float) -> None:
        self.references, self.angle = references, math.acos(max(-1.0, min(1.0, over)))
        self.low = {d: np.full(len(r), np.inf) for d, r in references.items()}
        self.high = {d: np.full(len(r), -np.inf) for d, r in references.items()}

    def reached(self, dim: int, units: np.ndarray) -> np.ndarray:
        """Which cells may hold a vector within the angle of each."""
        at = angles(units, self.references[dim])
        near = (at <= self.high[dim] + self.angle + SLACK) & (at >= self.low[dim] - self.angle - SLACK)
        return near & (at - at.min(axis=1, keepdims=True) <= 2 * self.angle + SLACK)


def _placed(df: DataFrame, v: str, cells: Cells, own: bool) -> DataFrame:
    """Rows with unit vectors, dim, and their own cell and angle or the cells that they reach."""
    extra = "dim int, cell int, angle double" if own else "dim int, cells array<int>"
    spec = T.StructType([*df.schema, *T._parse_datatype_string(extra)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = f[v].map(len).to_numpy()
            for dim in np.unique(sizes):
                if int(dim) not in cells.references:
                    continue
                part = f[sizes == dim].reset_index(drop=True)
                units = unit(part[v].to_list())[0]
                part[v], part["dim"] = list(units), int(dim)
                if own:
                    at = angles(units, cells.references[int(dim)])
                    part["cell"], part["angle"] = at.argmin(axis=1), at.min(axis=1)
                else:
                    part["cells"] = [np.flatnonzero(r) for r in cells.reached(int(dim), units)]
                yield part

    return df.mapInPandas(run, spec)


def blocked(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides in blocks (right) and parts (left) of about ``rows`` rows of a key, a row once for each of the other side's, and how many groups that makes."""
    load = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).alias(n))
    loads = cut(load(right, "blocks").join(load(left, "parts"), keys))
    groups = loads.agg(F.sum(F.col("blocks") * F.col("parts"))).first()[0] or 0
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = right.join(small(loads), keys).withColumn("block", F.pmod(F.xxhash64("b", "v"), "blocks")).withColumn("part", each("parts"))
    left = left.join(small(loads), keys).withColumn("part", F.pmod(F.xxhash64("a", "v"), "parts")).withColumn("block", each("blocks"))
    return left, right, groups


def _cosines(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of all rows of two results of ``unit``; 0 where lengths differ."""
    (u, n), (v, m) = x, y
    dim = min(u.shape[1], v.shape[1])
    return np.where(n[:, None] == m[None, :], u[:, :dim] @ v[:, :dim].T, 0.0)


def matched(left: DataFrame, right: DataFrame, keys: list[str], choose: Callable[[np.ndarray], np.ndarray], groups: int, also: float | None = None) -> DataFrame:
    """(a, b, similarity) of the pairs of equal keys that ``choose`` marks in a matrix of cosines.

    With ``also`` sides have w too, unit vectors or zeros, and a pair's w must
    be of one length and their cosine over it.

    Sides have (keys, block, part, a or b, v), v of length 1. Equal (keys,
    block, part) come together in a task, the left ones held; the columns of a
    matrix are in the order of b, and may be some of a group's.
    """
    by, vectors = [*keys, "block", "part"], ["v"] if also is None else ["v", "w"]
    both = left.select(*by, F.lit(0).alias("side"), F.col("a"), F.lit(None).cast(right.schema["b"].dataType).alias("b"), *vectors)
    both = both.unionByName(right.select(*by, F.lit(1).alias("side"), F.lit(None).cast(left.schema["a"].dataType).alias("a"), "b", *vectors))
    both = both.repartition(max(1, min(TASKS, groups)), *by).sortWithinPartitions(*by, "side")
    spec = T.StructType([left.schema["a"], right.schema["b"], T.StructField("similarity", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, held, second = None, [], [], []
        for f in frames:
            turn = np.flatnonzero(np.concatenate([[True], (f[by].iloc[1:].to_numpy() != f[by].iloc[:-1].to_numpy()).any(axis=1)])) if len(f) else []
            for a, b in zip(turn, [*turn[1:], len(f)]):
                part = f.iloc[a:b]
                now = tuple(part[by].iloc[0])
                if now != key:
                    key, ids, held, second = now, [], [], []
                asking, answering = part[part["side"] == 0], part[part["side"] == 1].sort_values("b", kind="stable")
                if len(asking):
                    ids += asking["a"].to_list()
                    held.append(np.stack(asking["v"].to_list()))
                    if also is not None:
                        second += asking["w"].to_list()
                if not len(answering) or not held:
                    continue
                held = [np.concatenate(held)]
                y, known = np.stack(answering["v"].to_list()), answering["b"].to_list()
                z = unit(answering["w"].to_list()) if also is not None else None
                for at in range(0, len(ids), 256):
                    s = held[0][at : at + 256] @ y.T
                    chosen = choose(s)
                    if z is not None:
                        chosen &= _cosines(unit(second[at : at + 256]), z) > also
                    i, j = np.nonzero(chosen)
                    if len(i):
                        yield pd.DataFrame({"a": pd.Series([ids[at + k] for k in i.tolist()]), "b": pd.Series([known[k] for k in j.tolist()]), "similarity": s[i, j]})

    return both.mapInPandas(run, spec)


def cosine_of(pairs: DataFrame, left: DataFrame, right: DataFrame, rows: int = ROWS) -> DataFrame:
    """(a, b, similarity) of given pairs (a, b), 0 where a vector is null, zero, not finite or of another length.

    ``left`` has a and v, ``right`` b and v; each row of an id gives one. Ids
    are dealt to blocks by a hash; vectors go once to each block of the other
    side, not to each pair.
    """
    blocks = [max(1, -(-df.count() // rows)) for df in (left, right)]
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    types = {"a": left.schema["a"].dataType, "b": right.schema["b"].dataType, "v": left.schema["v"].dataType}
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    both = left.select(at("a", blocks[0]).alias("x"), each(blocks[1]).alias("y"), F.lit(0).alias("side"), "a", none("b"), "v")
    both = both.unionByName(right.select(each(blocks[0]).alias("x"), at("b", blocks[1]).alias("y"), F.lit(1).alias("side"), none("a"), "b", F.col("v").cast(types["v"]).alias("v")))
    both = both.unionByName(pairs.select(at("a", blocks[0]).alias("x"), at("b", blocks[1]).alias("y"), F.lit(2).alias("side"), "a", "b", none("v")))
    both = both.repartition(max(1, min(TASKS, blocks[0] * blocks[1])), "x", "y").sortWithinPartitions("x", "y", "side")
    spec = T.StructType([left.schema["a"], right.schema["b"], T.StructField("similarity", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, made = None, ([], []), None
        for f in frames:
            for now, part in f.groupby(["x", "y"], sort=False):
                if now != key:
                    key, held, made = now, ([], []), None
                for side in (0, 1):
                    some = part[part["side"] == side]
                    if len(some):
                        held[side].append(some)
                asked = part[part["side"] == 2]
                if not len(asked) or not all(held):
                    continue
                if made is None:
                    made = [pd.concat(h) for h in held]
                    ids = [pd.DataFrame({c: m[c].to_numpy(), f"at_{c}": np.arange(len(m))}) for c, m in zip("ab", made)]
                    (u, n), (w, m) = (unit(x["v"].to_list()) for x in made)
                    dim = min(u.shape[1], w.shape[1])
                found = asked[["a", "b"]].merge(ids[0], on="a").merge(ids[1], on="b")
                i, j = found["at_a"].to_numpy(), found["at_b"].to_numpy()
                s = np.where(n[i] == m[j], np.einsum("ij,ij->i", u[i, :dim], w[j, :dim]), 0.0)
                yield found[["a", "b"]].assign(similarity=s)

    return both.mapInPandas(run, spec)


def cosine_over(left: DataFrame, right: DataFrame, over: float, on: Sequence[str] = (), references: int = REFERENCES, cell: int = CELL, rows: int = ROWS, direct: int = DIRECT, also: float | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs, equal in ``on``, whose vectors' cosine is over ``over``.

    With ``also`` both sides have w, and the pair's w must have a cosine over it.

    ``left`` has a and v, ``right`` b and v, both ``on``; ids tell their rows
    apart, or pairs are repeated. Vectors that are null, zero, of other lengths
    or not finite match nothing, nor do null keys. References are
    ``references`` at most, drawn from the right by hashes.
    """
    on, more = list(on), [] if also is None else ["w"]
    left, right = usable(left.select(*on, "a", "v", *more), "v"), usable(right.select(*on, "b", "v", *more), "v")
    if more:
        left, right = usable(left, "w"), usable(right, "w")
    if on:
        count = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
        large = cut(count(left, "n").join(count(right, "m"), on).filter(F.col("n") * F.col("m") > direct).select(*on))
        pairs = left.join(small(large), on, "left_anti").join(right.withColumnsRenamed({"v": "__v", "w": "__w"}), on).filter(F.size("v") == F.size("__v"))
        if more:
            pairs = pairs.filter((F.size("w") == F.size("__w")) & (cosine(F.col("w"), F.col("__w")) > also))
        pairs = pairs.select("a", "b", cosine(F.col("v"), F.col("__v")).alias("similarity")).filter(F.col("similarity") > over)
        if not large.limit(1).count():
            return pairs
        left, right = left.join(small(large), on, "left_semi"), right.join(small(large), on, "left_semi")
        return pairs.unionByName(_by_cells(left, right, over, on, references, cell, rows, also))
    return _by_cells(left, right, over, on, references, cell, rows, also)


def _by_cells(left: DataFrame, right: DataFrame, over: float, on: list[str], references: int, cell: int, rows: int, also: float | None = None) -> DataFrame:
    sizes = right.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length of vectors
    found: dict[int, np.ndarray] = {}
    for r in sizes:
        some = right.filter(F.size("v") == r.dim).orderBy(F.xxhash64("v"), "v").select("v").limit(max(1, min(references, -(-r.n // cell)))).toPandas()
        found[r.dim] = unit(some["v"].to_list())[0]
    cells = Cells(found, over)
    right = cut(_placed(right, "v", cells, own=True))
    for r in right.groupBy("dim", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row for each reference
        cells.low[r.dim][r.cell], cells.high[r.dim][r.cell] = r.low, r.high
    left = cut(_placed(left, "v", cells, own=False)).withColumn("cell", F.explode("cells")).drop("cells")
    keys = [*on, "dim", "cell"]
    left, right, groups = blocked(left, right.drop("angle"), keys, rows)
    return matched(left, right, keys, lambda s: s > over, groups, also)
