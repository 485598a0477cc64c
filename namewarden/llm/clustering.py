"""Centroid clustering of integer vectors by annulus search.

Centroids are sorted by norm. A vector's distance to the centroid that it
belonged to bounds the distance to its nearest one, and no centroid whose norm
differs from the vector's by more than that can be as near; binary searches
give the places of the norms that do not, and those centroids are compared
exactly, in integers. The bound is widened by a little for rounded norms, so
that ties at the boundary are compared too.

Vectors are written once, packed, beside their first centroid. A round reads
them, adds up each task's sums of every centroid, and these few are added up by
Spark; vectors aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewarden.llm.common import BATCH_BYTES, cut, trim

#: Components of a vector; what they are multiplied by; centroids; rounds.
DIM, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Scaled components are held to this either way, so that any distance is a long.
MOST = 1 << 27
#: Vectors compared at once.
ROWS = 4096


class Centroids:
    """Integer centroids by norm; ``numbers`` tells which one each is."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows.astype(np.int64)
        norms = np.sqrt((self.rows.astype(np.float64) ** 2).sum(axis=1))
        self.numbers = np.argsort(norms, kind="stable")
        self.norms = norms[self.numbers]

    def distances(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Squared distances of each vector to the centroid of its number."""
        gap = x - self.rows[number]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest_norm(self, x: np.ndarray) -> np.ndarray:
        """The number of a centroid of a norm next to each vector's, to begin with."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        return self.numbers[np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)]

    def nearest(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each vector, ties to smaller numbers, and how many were compared.

        ``own``: a centroid's number for each, whose distance is the bound.
        """
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        bound = np.sqrt(self.distances(x, own).astype(np.float64))
        slack = 1e-9 * (norm + bound + (self.norms[-1] if len(self.norms) else 0)) + 1e-9
        low = np.searchsorted(self.norms, norm - bound - slack, side="left")
        sizes = np.searchsorted(self.norms, norm + bound + slack, side="right") - low
        number, distance, compared = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
        for a in range(0, len(x), ROWS):
            some = slice(a, a + ROWS)
            n = sizes[some]
            starts = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n)
            which = self.numbers[np.repeat(low[some] - starts, n) + np.arange(len(row))]
            d = self.distances(x[some][row], which)
            least = np.minimum.reduceat(d, starts)
            tied = np.where(d == least[row], which, len(self.rows))
            number[some], distance[some], compared = np.minimum.reduceat(tied, starts), least, compared + len(row)
        return number, distance, compared


def kept(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v) of the vectors of ``dim`` components, none null or not finite."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter((F.size("v") == dim) & sound)


def scaled(rows: list, scale: int) -> np.ndarray:
    """floor(scale x) of every component, held to ``MOST``."""
    return np.clip(np.floor(np.stack(rows).astype(np.float64) * scale), -MOST, MOST).astype(np.int64)


def first_centroids(vectors: DataFrame, n: int, scale: int) -> np.ndarray:
    """The scaled vectors of the n smallest sha256 of ``1:<id>``, ascending; of equal ones the least vector first."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(n).toPandas()
    return scaled(rows["v"].to_list(), scale) if len(rows) else np.zeros((0, 0), np.int64)


def _packed(vectors: DataFrame, centroids: Centroids, dim: int, scale: int) -> DataFrame:
    """(id, v, own): vectors as bytes and their first nearest centroid."""
    spec = T.StructType([vectors.schema["id"], T.StructField("v", T.BinaryType()), T.StructField("own", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(spec)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = scaled([batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)], scale)[0]
            number, _, _ = centroids.nearest(x, centroids.nearest_norm(x))
            small = x.astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field("id").type), pa.array([r.tobytes() for r in small], pa.binary()), pa.array(number, pa.int32())], schema=out)

    return vectors.mapInArrow(run, spec)


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _moved(packed: DataFrame, centroids: Centroids, dim: int) -> np.ndarray:
    """The centroids moved to the floored means of their vectors; those without vectors stay."""
    n = len(centroids.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((n, dim), np.int64), np.zeros(n, np.int64)
        for batch in batches:
            x = _unpacked(batch.column(0), dim)
            number, _, _ = centroids.nearest(x, batch.column(1).to_numpy().astype(np.int64))
            by = np.argsort(number, kind="stable")
            at = np.flatnonzero(np.diff(number[by], prepend=-1))
            if len(at):
                sums[number[by][at]] += np.add.reduceat(x[by], at, axis=0)
            sizes += np.bincount(number, minlength=n)
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sizes[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    few = packed.select("v", "own").mapInArrow(run, "cluster int, n long, sums array<long>")
    whole = few.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)))
    rows = centroids.rows.copy()
    for r in whole.collect():  # a row for each centroid
        rows[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
    return rows


def assign(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector after the last round, and the centroids.

    Kept are vectors of ``dim`` components of which none is null or not finite;
    a component x counts as floor(scale x), held to ``MOST`` either way. Fewer
    kept vectors than ``centroids`` make fewer; ones alike make centroids
    alike, of which the first has the vectors. Rows that repeat an id are
    clustered one by one; a null id is hashed as an empty one. The centroids
    (``centroids`` x ``dim`` integers) are the only data that the driver holds.
    """
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    usable = kept(vectors, id_col, vec_col, dim)
    rows = first_centroids(usable, centroids, scale)
    if not len(rows):
        return usable.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter(F.lit(False)), rows
    packed = cut(_packed(usable, Centroids(rows), dim, scale))
    for _ in range(rounds):
        rows = _moved(packed, Centroids(rows), dim)
    last = Centroids(rows)
    spec = T.StructType([packed.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(spec)
        for batch in batches:
            if batch.num_rows:
                number, distance, _ = last.nearest(_unpacked(batch.column(1), dim), batch.column(2).to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field("id").type), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], schema=out)
        trim()

    return packed.mapInArrow(run, spec).withColumnRenamed("id", id_col), rows


def clustered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, see ``assign``.

    The digest is of the final centroid's components in decimal, comma-joined.
    No kept vector: no rows.
    """
    import hashlib

    found, rows = assign(vectors, id_col, vec_col, **options)
    found = cut(found)
    own = F.col("distance").cast("decimal(38,0)")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(own).alias("s")).collect()}  # a row for each centroid
    table = pd.DataFrame({"cluster": pd.Series(sums.keys(), dtype="int32"), "cluster_inertia": pd.Series(sums.values(), dtype="int64"), "centroid_sha256": pd.Series([hashlib.sha256(",".join(map(str, rows[k].tolist())).encode()).hexdigest() for k in sums], dtype="object")})
    few = found.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, centroid_sha256 string")
    # as many rows as centroids
    return found.join(F.broadcast(few), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")


def _rounds(rounds: int) -> str:
    step = """a{k} AS (SELECT vec_id, v, n, d FROM (SELECT t.vec_id, t.v, c.n, list_sum(list_transform(list_zip(t.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d, row_number() OVER (PARTITION BY t.at ORDER BY list_sum(list_transform(list_zip(t.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.n) AS place FROM x t, c{k} c) WHERE place = 1)"""
    move = """m{k} AS (SELECT n, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*))::HUGEINT // count(*)::HUGEINT AS z FROM (SELECT n, unnest(v) AS y, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY n, i),
c{j} AS (SELECT c.n, coalesce(w.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT n, list(z::BIGINT ORDER BY i) AS c FROM m{k} GROUP BY n) w ON w.n = c.n)"""
    return ",\n".join(part for k in range(rounds + 1) for part in ([step.format(k=k), move.format(k=k, j=k + 1)] if k < rounds else [step.format(k=k)]))


#: DuckDB SQL of ``clustered`` with its defaults.
ORACLE = f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::BIGINT) AS v, row_number() OVER () AS at FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y::DOUBLE))) = 64),
c0 AS (SELECT (row_number() OVER (ORDER BY h))::INTEGER - 1 AS n, v AS c FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM x ORDER BY 1 LIMIT {CENTROIDS})),
{_rounds(ROUNDS)}
SELECT vec_id, a.n AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.n = c.n"""
