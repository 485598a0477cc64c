"""All pairs of vectors, block against block: their rows, or counts of them by score.

Vectors are dealt to blocks by a hash of their id; a task multiplies two blocks
at a time, so that a vector is sent once for each block and a pair is never
shuffled. Counts are added up in a task before they leave it. The work still
grows with the square of the vectors.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most vectors of a block, pairs that are looked at at once, and most tasks, of a cell of two blocks each up to that.
BLOCK, TILE, TASKS = 16_384, 1_000_000, 20_000
#: Most vectors of a block whose pairs' edits are held, pairs that are put in order at once, about, and rows of a batch of them.
EDITED, ORDERED, BATCH = 6144, 8_000_000, 250_000
#: Vectors by which found pairs are dealt to ranges, rows of a range, about, and found pairs that a task holds.
SAMPLE, RANGE, FOUND = 2048, 2_000_000, 1_000_000
#: Blocks of a table that has 1024 vectors for each; tasks that give counts by level before a task takes more than a cell.
SPREAD, TALLIES = 8, 256


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in double precision, padded with zeros, and their dimensions; zeros for null, zero or not finite ones."""
    sizes = np.array([0 if v is None else len(v) for v in vectors], np.int64)
    out = np.zeros((len(vectors), max(1, sizes.max(initial=0))))
    for i, v in enumerate(vectors):
        if v is not None:
            out[i, : len(v)] = np.array(v, np.float64)
    out[~np.isfinite(out).all(axis=1)] = 0
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0), sizes


def _stretch(at: np.ndarray) -> np.ndarray | slice:
    """A slice for numbers that follow one another."""
    return slice(at[0], at[-1] + 1) if at[-1] - at[0] + 1 == len(at) else at


def _taken(x: np.ndarray, at: np.ndarray | slice, axis: int) -> np.ndarray:
    return x if isinstance(at, slice) else x.take(at, axis)


class Spelled:
    """Names or numbers in decimal, by length: what is written before each letter is kept once for all that begin so."""

    def __init__(self, ids: np.ndarray) -> None:
        names = [str(i).encode("utf-32-le") for i in ids.tolist()]
        self.count, self.longest, self.of = len(names), max(map(len, names), default=0) // 4, {}
        sizes = np.array([len(s) // 4 for s in names], np.int64)
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            letters = np.frombuffer(b"".join(names[i] for i in at), np.int32).reshape(len(at), n)
            group, levels = np.zeros(len(at), np.int64), []
            for i in range(n):
                # a beginning is one letter shorter and a letter
                kinds, first, now = np.unique(group * 0x110000 + letters[:, i], return_index=True, return_inverse=True)
                levels.append((group[first], letters[first, i]))
                group = now.reshape(-1)
            everyone = n > 0 and np.array_equal(group, np.arange(len(at)))
            self.of[n] = _stretch(at), slice(None) if everyone else group, levels


def edits(a: np.ndarray | Spelled, b: np.ndarray | Spelled) -> np.ndarray:
    """Levenshtein distances of every a and every b, names or numbers in decimal, in code points."""
    x, y = (z if isinstance(z, Spelled) else Spelled(z) for z in (a, b))
    kind = np.int8 if max(x.longest, y.longest) < 127 else np.int32
    out = np.zeros((x.count, y.count), kind)
    for at_x, end_x, levels_x in x.of.values():
        for at_y, end_y, levels_y in y.of.values():
            last = [np.full((1, 1 if j == 0 else len(levels_y[j - 1][0])), j, kind) for j in range(len(levels_y) + 1)]
            for i, (up, cx) in enumerate(levels_x, 1):
                row = [np.full((len(up), 1), i, kind)]
                for j, (back, cy) in enumerate(levels_y, 1):
                    near = last[j - 1].take(up, 0).take(back, 1)
                    near += (cx[:, None] != cy[None, :]).view(np.int8)
                    less = np.minimum(last[j].take(up, 0), row[j - 1].take(back, 1))
                    less += kind(1)
                    row.append(np.minimum(less, near, out=near))
                last = row
            found = _taken(_taken(last[-1], end_x, 0), end_y, 1)
            if isinstance(at_x, slice) and isinstance(at_y, slice):
                out[at_x, at_y] = found
            else:
                every = [np.arange(n)[at] for n, at in ((x.count, at_x), (y.count, at_y))]
                out[np.ix_(*every)] = found
    return out


def least_cosines(e: int, threshold: float, most: float) -> list[float]:
    """For each weight k / 10 the least cosine at which names of ``e`` edits are a hit: the score never falls with the cosine."""
    out = []
    for k in range(11):
        hit = lambda s: s * (k * 0.1) + (1 - e / most) * (1 - k * 0.1) >= threshold - 1e-12  # noqa: B023, E731
        low, high = -2.0, 2.0  # roundings included
        if hit(low) or not hit(high):
            out.append(-np.inf if hit(low) else np.inf)
            continue
        while low < (middle := (low + high) / 2) < high:
            low, high = (low, middle) if hit(middle) else (middle, high)
        out.append(high)
    return out


def _id_type(vectors: DataFrame, id_col: str) -> str:
    """long for whole numbers, else string."""
    return "long" if isinstance(vectors.schema[id_col].dataType, T.IntegralType) else "string"


def _cells(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, block: int, few: bool = False) -> DataFrame:
    """Every vector once for each two blocks that it is in one of, the rows of two blocks together in a partition; ``few`` puts up to eight cells of many in one."""
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast(_id_type(vectors, id_col)).alias("id"), v.alias("v"), F.col(label_col).cast("double").alias("label"))
    n = rows.count()
    blocks = max(1, -(-n // block), min(SPREAD, n // 1024))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = rows.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "v", "label")
    cells = blocks * (blocks + 1) // 2
    tasks = min(cells, max(TALLIES, cells // 8)) if few else cells
    tasks = max(1, min(TASKS, tasks))
    # by number: a hash of so few cells would give some tasks several and others none
    task = F.pmod(F.expr("high * (high + 1) div 2 + low"), F.lit(tasks)).cast("int")
    return rows.repartitionById(tasks, task).sortWithinPartitions("low", "high", "block")


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one (low, high) at a time from sorted frames."""
    held: list[pd.DataFrame] = []
    for f in frames:
        for key, part in f.groupby(["low", "high"], sort=False):
            if held and (held[0].low.iat[0], held[0].high.iat[0]) != key:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _cell(f: pd.DataFrame) -> tuple:
    """(whether both are one block, its rows x and y) of the rows of two blocks; rows are (ids, labels, vectors of length 1, dimensions), ordered by id."""
    f = f.sort_values("id")
    low, high = f.low.iat[0], f.high.iat[0]
    (u, size), ids, labels, block = unit(f.v.tolist()), (f.id.to_numpy(str) if f.id.dtype == object or str(f.id.dtype).startswith("str") else f.id.to_numpy(np.int64)), f.label.to_numpy(np.float64), f.block.to_numpy()
    return low == high, *((ids[at], labels[at], u[at], size[at]) for at in (block == low, block == high))


def _slices(cell: tuple, most: int) -> list[slice]:
    """Stretches of x that have up to ``most`` pairs with all of y, or a row of them."""
    rows = max(1, most // max(1, len(cell[2][0])))
    return [slice(at, at + rows) for at in range(0, len(cell[1][0]), rows)]


def _stretches(cell: tuple, most: int) -> Iterator[tuple]:
    """(ids of x, ids of y, labels of x, labels of y, cosines, whether the pair counts) for stretches of x and all of y; ids of y stay the same object."""
    one, (xs, lx, ux, dx), (ys, ly, uy, dy) = cell
    for i in _slices(cell, most):
        s = ux[i] @ uy.T
        s[dx[i][:, None] != dy[None, :]] = 0
        yield xs[i], ys, lx[i], ly, s, xs[i][:, None] < ys[None, :] if one else np.ones(s.shape, bool)


def _tiles(frames: Iterator[pd.DataFrame], most: int = TILE) -> Iterator[tuple]:
    """The stretches of one cell of two blocks after the other."""
    for f in _groups(frames):
        yield from _stretches(_cell(f), most)


def pairs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", below: float | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, s, same) for all pairs a < b of ids, or those of a cosine under ``below``; same is null where a label is.

    There are n (n - 1) / 2 pairs of n ids; they aren't shuffled or held.
    """

    def run(frames):
        for xs, ys, lx, ly, s, once in _tiles(frames):
            i, j = np.nonzero(once if below is None else once & (s < below))
            a, b = xs[i], ys[j]
            same = pd.Series(lx[i] == ly[j], dtype=object).where(~(np.isnan(lx[i]) | np.isnan(ly[j])), None)
            yield pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "s": s[i, j], "same": same})

    return _cells(vectors, id_col, vector_col, label_col, block).mapInPandas(run, "a {0}, b {0}, s double, same boolean".format(_id_type(vectors, id_col)))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers of eight bytes, first bytes together, then second ones and so on, or of strings, compressed."""
    out = io.BytesIO()
    for x in columns:
        np.save(out, x if x.dtype.kind == "U" else np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8).T))
    return zlib.compress(out.getbuffer(), 1)


def _unpacked(packed: bytes, *kinds: type) -> list[np.ndarray]:
    read = io.BytesIO(zlib.decompress(packed))
    columns = [np.load(read) for _ in kinds]
    return [x if x.dtype.kind == "U" else np.ascontiguousarray(x.T).view(kind).reshape(-1) for x, kind in zip(columns, kinds)]


def _ends(vectors: DataFrame, id_col: str, vector_col: str, below: float, each: int) -> list[float]:
    """Cosines under ``below`` that part its pairs into ranges of about ``each``, by those of a bounded sample."""
    known = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    n = known.count()
    u, size = unit([r.v for r in known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    s = u @ u.T
    s[size[:, None] != size[None, :]] = 0
    s = s[np.triu_indices(len(s), 1)]
    hits = s[s < below]
    parts = max(1 + int(len(hits) / max(1, len(s)) * n * (n - 1) / 2 / each), min(16, n // 4096))
    # what no sampled pair tells goes by even steps
    return np.quantile(np.concatenate([hits, np.linspace(-1, below, 64)]), np.arange(1, min(TASKS, parts)) / min(TASKS, parts)).tolist()


def ordered_pairs(vectors: DataFrame, below: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, each: int = RANGE) -> DataFrame:
    """(a, b, s) for all pairs a < b of ids of a cosine under ``below``, ordered by s, a and b.

    Cosines are worked out once. Pairs are shuffled to ranges of cosines,
    packed: those of two blocks that go to a range are one row. A range's rows
    are then sorted by Spark, about ``each`` of them.
    """
    ends, kind = _ends(vectors, id_col, vector_col, below, each), _id_type(vectors, id_col)
    whole = kind == "long"

    def packed(held):
        x, y, s = (np.concatenate(c) for c in zip(*held))
        at = np.searchsorted(ends, s, "right")
        order = np.argsort(at, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            # ids of x ascend, so that the steps between them are small
            yield at[some[0]], _packed(np.diff(x[some], prepend=np.int64(0)) if whole else x[some], y[some], s[some])

    def run(frames):
        for f in _groups(frames):
            held, n = [], 0
            for xs, ys, _, _, s, once in _stretches(_cell(f), TILE):
                i, j = np.nonzero(once & (s < below))
                if len(i):
                    held.append((xs[i], ys[j], s[i, j]))
                n += len(i)
                if n >= FOUND:
                    yield pd.DataFrame(packed(held), columns=["at", "packed"])
                    held, n = [], 0
            if held:
                yield pd.DataFrame(packed(held), columns=["at", "packed"])

    def rows(frames):
        for f in frames:
            for p in f.packed:
                x, y, s = _unpacked(p, np.int64, np.int64, np.float64)
                x = np.cumsum(x) if whole else x
                yield pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "s": s})

    found = _cells(vectors, id_col, vector_col, label_col, block).mapInPandas(run, "at int, packed binary")
    return found.repartitionById(len(ends) + 1, F.col("at")).mapInPandas(rows, f"a {kind}, b {kind}, s double").sortWithinPartitions("s", "a", "b")


def _ranges(cell: tuple, most: int) -> list[tuple[float, float]]:
    """Ranges of cosines, from the first up to the second, that hold about ``most`` pairs of a cell each, by some of its rows."""
    one, (xs, lx, ux, dx), y = cell
    n = len(xs) * len(y[0]) // (1 + one)
    some = slice(None, None, max(1, len(xs) * len(y[0]) // TILE))
    s = [s[once] for *_, s, once in _stretches((one, (xs[some], lx[some], ux[some], dx[some]), y), TILE)]
    s = np.concatenate(s) if s else np.zeros(0)
    ends = np.quantile(s, np.arange(1, -(-n // most)) / -(-n // most)).tolist() if len(s) and n > most else []
    return [(low, high) for low, high in zip([-np.inf, *ends], [*ends, np.inf]) if low < high]


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits as in SQL: halves away from zero, no -0."""
    x = x * 1e6
    digits = np.rint(x)
    halves = np.abs(x - digits) == 0.5
    if halves.any():
        digits[halves] = np.trunc(x[halves] + np.copysign(0.5, x[halves]))
    digits /= 1e6
    digits += 0.0
    return digits


def _keys(s: np.ndarray, e: np.ndarray, first: int, bits: int, most: int) -> np.ndarray:
    """Whole numbers in the order of cosine to six digits, then edits (up to ``most``), then cosine as far as 63 bits go; the last ``bits`` hold the pair's number, from ``first``."""
    digits = s * 1e6
    key = np.rint(digits)
    digits -= key
    digits += 0.5
    key += 1 << 20
    key = key.astype(np.int64)
    for_edits = min(most.bit_length(), 42 - bits)
    key <<= for_edits
    key |= np.minimum(e, (1 << for_edits) - 1) if most >> for_edits else e
    rest = 42 - bits - for_edits
    digits *= (1 << rest) - 1
    key <<= rest
    key |= digits.astype(np.int64)
    key <<= bits
    key |= np.arange(first, first + len(s))
    return key


def _in_order(cell: tuple, most: int) -> Iterator[tuple]:
    """(a, b, cosines, edits) of batches of a cell's pairs: range by range of cosines, ordered by digits and edits in a range.

    Edits of the cell are held, a byte for each pair; cosines are worked out again for each range.
    """
    width, size = len(cell[2][0]), len(cell[1][0]) * len(cell[2][0])
    place, spelled = np.uint32 if size < 2**32 else np.int64, Spelled(cell[2][0])
    changes = [edits(Spelled(cell[1][0][i]), spelled).reshape(-1) for i in _slices(cell, TILE)]
    longest = max((int(e.max(initial=0)) for e in changes), default=0)
    room = min(size, most + most // 4 + max(TILE, width))
    bits, kind = room.bit_length(), changes[0].dtype if changes else np.int8
    keys, places, cosines, apart = held = [np.empty(room, of) for of in (np.int64, place, np.float64, kind)]

    def batches(n):
        keys[:n].sort()
        for k in range(0, n, BATCH):
            some = keys[k : min(n, k + BATCH)] & ((1 << bits) - 1)
            at = places[some]
            i = at // width
            a, b = cell[1][0][i], cell[2][0][at - i * width]
            yield np.where(a < b, a, b), np.where(a < b, b, a), cosines[some], apart[some]

    for low, high in _ranges(cell, most):
        n, start = 0, 0
        for (*_, s, once), e in zip(_stretches(cell, TILE), changes):
            at = np.flatnonzero(once & (s >= low) & (s < high))
            if len(at):
                found = s.reshape(-1)[at], e[at]
                for whole, of in zip(held, (_keys(*found, n, bits, longest), at + start, *found)):
                    whole[n : n + len(at)] = of
            n, start = n + len(at), start + s.size
            if n > most + most // 4:
                yield from batches(n)
                n = 0
        if n:
            yield from batches(n)


def with_edits(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = EDITED, most: int = ORDERED, measures: dict[str, Callable] | None = None) -> DataFrame:
    """(a, b, s, edits) for all pairs a < b of ids: their cosine and the edits between the ids, names or numbers.

    ``measures`` are given instead of the last two, by name: doubles that the
    tasks make of arrays of both. There are n (n - 1) / 2 rows. Those of two
    blocks come range by range of cosines, about ``most`` pairs in each,
    ordered by cosine to six digits and edits: what is rounded of both repeats
    from row to row, so that files of it take a fraction of the bytes.
    """

    def run(frames):
        for f in _groups(frames):
            for a, b, s, e in _in_order(_cell(f), most):
                measured = {name: of(s, e) for name, of in measures.items()} if measures else {"s": s, "edits": e.astype(np.int32)}
                yield pd.DataFrame({"a": a, "b": b, **measured})

    columns = "".join(f", {name} double" for name in measures) if measures else ", s double, edits int"
    return _cells(vectors, id_col, vector_col, label_col, block).mapInPandas(run, "a {0}, b {0}".format(_id_type(vectors, id_col)) + columns)


def counted(vectors: DataFrame, level: Callable, low: int, high: int, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(level, p, n): how many of all pairs have equal and how many unequal labels at each level from low to high.

    ``level`` makes whole numbers of cosines; those past an end count there.
    Pairs with a null label don't count.
    """

    def run(frames):
        total = np.zeros(2 * (high - low + 1), np.int64)
        for _, _, lx, ly, s, once in _tiles(frames):
            known = once & ~(np.isnan(lx)[:, None] | np.isnan(ly)[None, :])
            at = (np.clip(level(s), low, high) - low).astype(np.int64) * 2 + (lx[:, None] == ly[None, :])
            at = at[known]
            if len(at):
                first = at.min()
                counts = np.bincount(at - first)
                total[first : first + len(counts)] += counts
        n, p = total.reshape(-1, 2).T
        at = np.flatnonzero(n + p)
        yield pd.DataFrame({"level": at + low, "p": p[at], "n": n[at]})

    few = _cells(vectors, id_col, vector_col, label_col, block, few=True).mapInPandas(run, "level long, p long, n long")
    return few.groupBy("level").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def weights(vectors: DataFrame, threshold: float, most: float = 5.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(k, tp, fp, tn, fn) over all pairs at each weight k / 10 of the cosine, the rest that of 1 - edits of the ids, names or numbers, / ``most``."""

    def run(frames):
        total, least, asked, spelled = np.zeros((11, 4), np.int64), {}, None, None
        for xs, ys, lx, ly, s, once in _tiles(frames):
            if ys is not asked:
                asked, spelled = ys, Spelled(ys)
            known = once & ~(np.isnan(lx)[:, None] | np.isnan(ly)[None, :])
            same, e = lx[:, None] == ly[None, :], edits(Spelled(xs), spelled)
            for d in range(int(e.min(initial=0)), int(e.max(initial=0)) + 1):
                at = known & (e == d)
                if not at.any():
                    continue
                if d not in least:
                    least[d] = least_cosines(d, threshold, most)
                for j, of in enumerate((s[at & ~same], s[at & same])):
                    hits = np.array([np.count_nonzero(of >= x) for x in least[d]])
                    total[:, 2 * j + 1] += hits
                    total[:, 2 * j] += len(of) - hits
        yield pd.DataFrame({"k": range(11), "tp": total[:, 3], "fp": total[:, 1], "tn": total[:, 0], "fn": total[:, 2]})

    few = _cells(vectors, id_col, vector_col, label_col, block).mapInPandas(run, "k int, tp long, fp long, tn long, fn long")
    return few.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")))
