"""Approximate nearest neighbours by a permutation index.

A vector is known by the order of its ``PREFIX`` nearest pivots. The index
posts it in the inverted files of its ``POSTED`` nearest ones; files lie in
buckets by pivot. A query is sent only to the buckets that hold files of its
own nearest pivots (``probed`` of them), adds up in each how far apart the
places of pivots are in both orders (the footrule; a pivot that one of the two
doesn't have counts as at place ``PREFIX``), takes the ``KEEP`` least of the
rows posted in its files, ties to smaller ids, and ranks these by exact cosine.

Pivots number about 4 times the root of the vectors, so a file's length and the
files that a query reads both grow slower than the vectors. A bucket whose
files or queries are many (one vector a million times) is split into blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewarden.llm.common import cut, small

#: Pivots come from a bounded sample (``SAMPLE`` rows a pivot, by least hashes of their ids), near-equal ones left out; most pivots.
SAMPLE, ALIKE, MOST = 4, 0.9, 1 << 16
#: Places of an order; files that a vector is posted in; rows of a bucket that are reranked for a query.
PREFIX, POSTED, KEEP = 64, 4, 384
#: Postings and queries wanted in a task.
ROWS, QUERIES = 16_384, 65_536
TOP = 5


def pivots_for(rows: int) -> int:
    return min(MOST, 4 * math.isqrt(rows) + 16)


def probed(pivots: int) -> int:
    """How many of its nearest pivots' files a query reads."""
    return min(pivots, math.ceil(3 * pivots**0.6))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim) of vectors that aren't null, empty or zero and have finite components only; rows that repeat an id are one, the least."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = vectors.schema[vec_col].dataType
    v = F.col(vec_col) if isinstance(getattr(kind, "elementType", None), T.FloatType) else F.col(vec_col).cast("array<double>")
    df = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    df = df.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad & F.exists("v", lambda x: x != 0))
    return df.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that nothing over- or underflows; cosines stay what they are."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Dot product over the lengths' product, sums exactly rounded."""
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def spread(sample: np.ndarray, pivots: int, block: int = 1024) -> np.ndarray:
    """The first so many rows that are under ``ALIKE`` in cosine to those before; a copied vector so is one pivot.

    Rows are held against those kept so far block by block, and against each other within a block.
    """
    kept = np.empty((min(pivots, len(sample)), sample.shape[1]))
    n = 0
    for a in range(0, len(sample), block):
        if n == len(kept):
            break
        some = sample[a : a + block]
        some = some[(some @ kept[:n].T).max(axis=1, initial=-1) < ALIKE]
        close, taken = some @ some.T >= ALIKE, np.zeros(len(some), bool)
        for i in range(len(some)):
            taken[i] = not (close[i, :i] & taken[:i]).any()
        some = some[taken][: len(kept) - n]
        kept[n : n + len(some)] = some
        n += len(some)
    return kept[:n]


def orders(units: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first, ties to the lesser number."""
    far = -(units @ pivots.T)
    if prefix >= far.shape[1]:
        return np.argsort(far, axis=1, kind="stable").astype(np.int32)
    some = np.sort(np.argpartition(far, prefix - 1, axis=1)[:, :prefix], axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)


class Files:
    """Inverted files of some rows: per pivot the rows that have it in their orders and at which place."""

    def __init__(self, order: np.ndarray, pivots: int) -> None:
        self.n, self.prefix = order.shape
        at = np.argsort(order.ravel(), kind="stable")
        self.row, self.place = (at // self.prefix).astype(np.int32), (at % self.prefix).astype(np.int32)
        self.start = np.searchsorted(order.ravel()[at], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """The footrule distance of every row to a query's order."""
        m = self.prefix
        # no pivot shared: both sides count every place's way to m
        far = np.full(self.n, m * (m + 1), np.int32)
        for place, pivot in enumerate(query.tolist()):
            a, b = self.start[pivot], self.start[pivot + 1]
            p = self.place[a:b]
            far[self.row[a:b]] += np.abs(p - place) - (m - p) - (m - place)
        return far

    def posted(self, pivots: np.ndarray, first: int) -> np.ndarray:
        """Whether each row has one of these pivots among its ``first`` nearest."""
        out = np.zeros(self.n, bool)
        for pivot in pivots.tolist():
            a, b = self.start[pivot], self.start[pivot + 1]
            out[self.row[a:b][self.place[a:b] < first]] = True
        return out


def search_bucket(index: pd.DataFrame, queries: pd.DataFrame, buckets: int, bucket: int, pivots: int, posted: int, keep: int, top: int) -> pd.DataFrame:
    """(query_id, id, score) of the nearest rows found in a bucket's files, ties to smaller ids."""
    index = index.sort_values("id")
    ids, vectors = index.id.to_numpy(), scaled(np.stack(index.v.to_list()).astype(float))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    files = Files(np.stack([np.frombuffer(o, np.int32) for o in index["order"]]), pivots)
    out: list[tuple] = []
    asked = scaled(np.stack(queries.v.to_list()).astype(float))
    for q, vector, order, probe in zip(queries.id.tolist(), asked, queries["order"], queries.probe):
        probe = np.frombuffer(probe, np.int32)
        near = np.flatnonzero(files.posted(probe[probe % buckets == bucket], posted))
        near = near[ids[near] != q]
        if len(near) > keep:
            far = files.footrule(np.frombuffer(order, np.int32))[near].astype(np.int64) * len(near) + np.arange(len(near))
            near = near[np.sort(np.argpartition(far, keep - 1)[:keep])]
        score = units[near] @ (vector / np.linalg.norm(vector))
        if len(near) > top:
            near = near[score >= np.partition(score, -top)[-top] - 1e-9]
        found = sorted((-cosine(vectors[i], vector), ids[i]) for i in near.tolist())[:top]
        out += [(q, i, -s) for s, i in found]
    return pd.DataFrame(out, columns=["query_id", "id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, pivots: int | None = None, prefix: int = PREFIX, posted: int = POSTED, keep: int = KEEP, rows: int = ROWS, queries_each: int = QUERIES, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the ``top`` nearest vectors found for each query by cosine.

    Both tables have ``id_col`` and ``vec_col``. Vectors that are null, empty,
    zero or not finite take no part, on either side; vectors of other lengths
    than a query's aren't its candidates; a query's own id isn't either. Rows
    that repeat an id are one vector, the least. A query of whose files few
    rows are posted, or fewer than ``top`` vectors, give fewer rows. Every
    vector is indexed; the pivots of each length come from a sample of at most
    ``SAMPLE`` rows a pivot. A query reads ``probes`` files, ``probed`` by
    default; ``exact`` has it read all and rerank every row, which gives what
    comparing all gives.
    """
    files = lambda n: n if exact else min(n, probes or probed(n))
    keep = 1 << 62 if exact else keep
    every, asked = cut(usable(vectors, id_col, vec_col)), usable(queries, id_col, vec_col)
    sizes = {r.dim: r.n for r in every.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {dim: pivots or pivots_for(n) for dim, n in sizes.items()}
    buckets = {dim: max(1, math.ceil(n * posted / rows)) for dim, n in sizes.items()}
    chosen: dict[int, np.ndarray] = {}
    for dim, n in wanted.items():
        sample = every.filter(F.col("dim") == dim).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE * n).select("v").toPandas()
        chosen[dim] = spread(unit(np.stack(sample.v.to_list()).astype(float)), n)

    def number(frames):
        """(id, v, order, probe, buckets of the posted and of the probed files) of each vector; none of another length than any indexed."""
        for f in frames:
            for dim, part in f.groupby("dim"):
                if dim not in chosen:
                    continue
                all_orders = orders(unit(np.stack(part.v.to_list()).astype(float)), chosen[dim], max(prefix, files(len(chosen[dim]))))
                order, probe = np.ascontiguousarray(all_orders[:, :prefix]), np.ascontiguousarray(all_orders[:, : files(len(chosen[dim]))])
                at = lambda x: [np.unique(r % buckets[dim]) for r in x]  # noqa: B023, E731
                yield pd.DataFrame({"id": part.id, "v": part.v, "dim": part.dim, "order": [r.tobytes() for r in order], "probe": [r.tobytes() for r in probe], "own": at(order[:, :posted]), "reads": at(probe)})

    spec = T.StructType([*every.schema, *T._parse_datatype_string("order binary, probe binary, own array<long>, reads array<long>")])
    shaped = lambda df: cut(df.mapInPandas(number, T.StructType([spec[c] for c in ("id", "v", "dim", "order", "probe", "own", "reads")])))
    index = shaped(every).select("id", "v", "dim", "order", F.explode("own").alias("bucket"))
    reads = shaped(asked).select("id", "v", "dim", "order", "probe", F.explode("reads").alias("bucket"))
    load = lambda df, each, out: df.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / each).alias(out))
    loads = small(cut(load(index, rows * 4, "blocks").join(load(reads, queries_each, "parts"), ["dim", "bucket"])))
    index, reads = index.join(loads, ["dim", "bucket"]), reads.join(loads, ["dim", "bucket"])
    block, part = F.pmod(F.xxhash64("id"), "blocks"), F.pmod(F.xxhash64("id", F.lit(2)), "parts")
    index = index.select("dim", "bucket", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", "v", "order")
    reads = reads.select("dim", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), part.alias("part"), "id", "v", "order", "probe")

    def search(key: tuple, rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asking):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        dim = int(key[0])
        return search_bucket(rows, asking, buckets[dim], int(key[1]), len(chosen[dim]), posted, keep, top)

    by = ("dim", "bucket", "block", "part")
    found = index.groupBy(*by).cogroup(reads.groupBy(*by)).applyInPandas(search, "query_id long, id long, score double")
    # a vector's files may lie in more buckets than one; each bucket gives a query few rows
    line = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def recall(vectors: np.ndarray, ids: np.ndarray, found: dict[int, list[int]], top: int = TOP) -> float:
    """The share of the exact ``top`` nearest of each query that were found, over rows of usable vectors."""
    units = unit(vectors.astype(float))
    at = {i: n for n, i in enumerate(ids.tolist())}
    hit = total = 0
    for q, got in found.items():
        score = units @ units[at[q]]
        score[at[q]] = -2
        best = np.lexsort((ids, -score.round(12)))[: min(top, len(ids) - 1)]
        hit, total = hit + len(set(ids[best].tolist()) & set(got)), total + len(best)
    return hit / max(1, total)
