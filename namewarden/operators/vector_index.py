"""An index of vectors on files: lists around centroids, searched by the few that can hold neighbours.

Centroids come from rounds of k-means on a bounded sample, each round a grouped
sum. Every vector is written under its nearest centroid's list, a partition of
the table, beside a table of the lists: centroid, number of vectors, and the
greatest angle of one to it. A search reads the partitions of its queries'
lists only. With ``probes`` each query asks its nearest lists; without, the
answer is exact: the nearest lists bound how far the last wanted neighbour is,
and every list whose ring comes within that is asked too.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewarden.operators.angles import SLACK, angles, blocked, matched, usable
from namewarden.operators.durable import cut, small
from namewarden.operators.pairwise import unit

#: Most lists; rows of the sample for each list; rounds; rows of a file, and of a block that is compared at once.
LISTS, SAMPLE, ROUNDS, ROWS, BLOCK = 1024, 64, 8, 100_000, 4096
#: Cosines are told apart to so many decimals.
DECIMALS = 12


def _sums(sample: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids moved to the mean directions of their vectors; those without stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros_like(centroids)
        for f in frames:
            units = unit(f["v"].to_list())[0]
            np.add.at(sums, (units @ centroids.T).argmax(axis=1), units)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        if len(used):
            yield pd.DataFrame({"list": used, "sums": list(sums[used])})

    few = sample.select("v").mapInPandas(run, "list int, sums array<double>")
    cells = few.select("list", F.posexplode("sums").alias("i", "x")).groupBy("list", "i").agg(F.sum("x").alias("x")).toPandas()  # lists x dimensions
    moved = centroids.copy()
    moved[cells["list"].unique()] = 0
    moved[cells["list"].to_numpy(), cells["i"].to_numpy()] = cells["x"].to_numpy()
    norms = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
    return np.where(norms > 0, moved / np.where(norms > 0, norms, 1), centroids)


def centroids_of(vectors: DataFrame, lists: int, rounds: int = ROUNDS, sample: int = SAMPLE) -> np.ndarray:
    """Directions of ``lists`` centroids, fitted on about ``sample`` vectors for each, drawn by hashes."""
    n = vectors.count()
    least = min(1.0, lists * sample / max(1, n))
    rows = cut(vectors.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(int(least * (1 << 30)))).select("v"))
    first = rows.distinct().orderBy(F.xxhash64("v", F.lit(1)), "v").limit(lists).toPandas()
    if not len(first):
        return np.zeros((0, 0))
    found = unit(first["v"].to_list())[0]
    for _ in range(rounds):
        found = _sums(rows, found)
    return found


def build(vectors: DataFrame, path: str, id_col: str, vec_col: str, lists: int | None = None, rounds: int = ROUNDS, rows: int = ROWS) -> dict:
    """Writes the index to a new folder and tells of it: rows, left_out, lists, largest_list, bytes, seconds.

    Vectors that are null, empty, zero or not finite are left out, as are those
    of other lengths than most have. By default there are about as many lists
    as the root of the vectors, ``LISTS`` at most. Rows that repeat an id are
    indexed one by one.
    """
    spark, began = vectors.sparkSession, time.time()
    sound = usable(vectors.select(F.col(id_col).alias("b"), F.col(vec_col).alias("v")), "v")
    whole = vectors.count()
    sizes = sound.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").limit(1).collect()
    n, dim = (sizes[0].n, sizes[0].dim) if sizes else (0, 0)
    sound = sound.filter(F.size("v") == dim)
    found = centroids_of(sound, lists or max(1, min(LISTS, math.isqrt(n))), rounds)
    spec = T.StructType([*sound.schema, *T._parse_datatype_string("list int, angle double")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                at = angles(unit(f["v"].to_list())[0], found)
                yield f.assign(list=at.argmin(axis=1), angle=at.min(axis=1))

    placed = cut(sound.mapInPandas(run, spec))
    of = cut(placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("far")))  # a row for each list
    # a long list is dealt to several files, so that no task writes it alone
    dealt = placed.join(F.broadcast(of.select("list", F.ceil(F.col("n") / rows).alias("files"))), "list").withColumn("file", F.pmod(F.xxhash64("b", "v"), "files"))
    files = of.agg(F.sum(F.ceil(F.col("n") / rows))).first()[0] or 1
    dealt.repartition(files, "list", "file").select("b", "v", "list").write.partitionBy("list").parquet(f"{path}/vectors")
    table = pd.DataFrame({"list": range(len(found)), "centroid": found.tolist()}) if len(found) else pd.DataFrame({"list": [], "centroid": []})
    spark.createDataFrame(table, "list int, centroid array<double>").join(of, "list").coalesce(1).write.parquet(f"{path}/lists")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    largest = of.agg(F.max("n")).first()[0] or 0
    return {"rows": n, "left_out": whole - n, "lists": of.count(), "largest_list": largest, "bytes": size, "seconds": time.time() - began}


#: Columns of a table of names that may hold vectors.
COLUMNS = ("embedding", "author_embedding", "package_embedding")


def build_all(table: DataFrame, path: str, key: str = "package_name", columns: Sequence[str] = COLUMNS, **options) -> dict[str, dict]:
    """An index for each vector column that the table has, at ``path``/column, and what ``build`` tells of each; none for a table without such columns."""
    return {c: build(table, f"{path}/{c}", key, c, **options) for c in columns if c in table.columns}


def _top(top: int):
    """Marks the ``top`` greatest of each row, of equal ones the first."""

    def choose(s: np.ndarray) -> np.ndarray:
        np.round(s, DECIMALS, out=s)
        if s.shape[1] <= top:
            return np.ones(s.shape, bool)
        last = np.partition(s, -top, axis=1)[:, -top][:, None]
        above, tied = s > last, s == last
        return above | (tied & (np.cumsum(tied, axis=1) <= top - above.sum(axis=1, keepdims=True)))

    return choose


def _best(pairs: DataFrame, top: int) -> DataFrame:
    line = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    return pairs.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top)


class Index:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # ``LISTS`` at most, unless more were asked for
        self.lists = np.array([r["list"] for r in rows], np.int64)
        self.centroids = np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))
        self.sizes, self.far = np.array([r.n for r in rows], np.int64), np.array([r.far for r in rows])

    def vectors(self, lists: list[int]) -> DataFrame:
        """(b, v, list) of some lists; the others' partitions aren't read."""
        return self.spark.read.parquet(f"{self.path}/vectors").filter(F.col("list").isin(lists))

    def _asked(self, queries: DataFrame, which) -> DataFrame:
        """Queries, of length 1, once for each list that ``which`` tells from their angles to the centroids and a bound."""
        lists = self.lists
        centroids = self.centroids
        spec = T.StructType([queries.schema["a"], queries.schema["v"], T.StructField("lists", T.ArrayType(T.IntegerType()))])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                f = f[f["v"].map(len) == centroids.shape[1]]
                if len(f):
                    units = unit(f["v"].to_list())[0]
                    mask = which(angles(units, centroids), f["bound"].to_numpy() if "bound" in f else None)
                    yield pd.DataFrame({"a": f["a"], "v": list(units), "lists": [lists[m] for m in mask]})

        return cut(queries.mapInPandas(run, spec)).select("a", "v", F.explode("lists").alias("list"))

    def _compared(self, asked: DataFrame, top: int, block: int) -> DataFrame:
        needed = [r["list"] for r in asked.select("list").distinct().collect()]  # as many as lists
        right = self.vectors(needed)
        spec = T.StructType([right.schema["b"], T.StructField("v", T.ArrayType(T.DoubleType())), right.schema["list"]])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield f.assign(v=list(unit(f["v"].to_list())[0]))

        left, right, groups = blocked(asked, right.select("b", "v", "list").mapInPandas(run, spec), ["list"], block)
        return matched(left, right, ["list"], _top(top), groups)

    def search(self, queries: DataFrame, id_col: str, vec_col: str, top: int = 10, probes: int | None = None, block: int = BLOCK, own: bool = False) -> DataFrame:
        """(query_id, rank, id, similarity): the ``top`` of the greatest cosine for each query, ties to smaller ids.

        With ``probes`` a query asks so many lists; without the result is that
        of comparing all. A vector of the query's own id is left out unless
        ``own``. Queries without a usable vector of the index's length have no
        rows. Queries' ids tell them apart.
        """
        more = top if own else top + 1
        q = usable(queries.select(F.col(id_col).alias("a"), F.col(vec_col).alias("v")), "v")
        sizes, far = self.sizes, self.far
        if not len(sizes):
            pairs = q.limit(0).select("a", F.col("a").alias("b"), F.lit(0.0).alias("similarity"))
        elif probes is not None:
            pairs = self._compared(self._asked(q, lambda at, _: at <= np.partition(at, min(probes, at.shape[1]) - 1, axis=1)[:, [min(probes, at.shape[1]) - 1]]), more, block)
        else:

            def nearest(at: np.ndarray, _) -> np.ndarray:
                """Each query's nearest lists, until these have enough vectors."""
                order = np.argsort(at, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                mask = np.zeros(at.shape, bool)
                np.put_along_axis(mask, order, before < more, axis=1)
                return mask

            def rest(at: np.ndarray, bound: np.ndarray) -> np.ndarray:
                return ~nearest(at, None) & (at - far[None, :] <= bound[:, None] + SLACK)

            first = cut(_best(self._compared(self._asked(q, nearest), more, block), more).drop("rank"))
            bound = first.groupBy("a").agg(F.when(F.count(F.lit(1)) >= more, F.acos(F.least(F.greatest(F.min("similarity"), F.lit(-1.0)), F.lit(1.0)))).otherwise(math.pi + 1).alias("bound"))
            pairs = first.unionByName(self._compared(self._asked(q.join(bound, "a"), rest), more, block))
        if not own:
            pairs = pairs.filter(F.col("a") != F.col("b"))
        return _best(pairs, top).select(F.col("a").alias("query_id"), "rank", F.col("b").alias("id"), "similarity")
