"""SimHash fingerprints of word shingles and their near-duplicate classes, by vantage-point trees.

A fingerprint has a set bit where over half of a text's shingle hashes have it.
Two fingerprints link at ``radius`` or fewer differing bits; classes are the
components of the links.

The search is a metric self-join. A vantage-point tree over a bounded sample
deals the distinct fingerprints to shards: at a node with vantage point v and
radius mu, x goes inside if d(x, v) <= mu, else outside, and an x outside with
d(x, v) <= mu + radius is also a visitor inside, as only there can it meet a
partner within ``radius`` (triangle inequality). Each pair so meets in a shard.
Inside a shard the tree goes on with one ring for each distance from a vantage
point: a ring meets only those whose distances differ by ``radius`` or less,
ring by ring from further vantage points, until few pairs are left to compare.
A shard gives a spanning star for each group found, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewarden.llm.common import cut, join_counted, map_texts, quoted, row_hash, small, trim
from namewarden.llm.components import connected_components
from namewarden.operators.durable import FEW

#: Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Of ``one_of_each`` beside these: words of a shingle and least similarity; bands, rows of a band (a pair at 0.8 shares
#: one with probability 0.9995); distinct sets in a band that are all paired; those of larger bands in a block of a cell.
WORDS, ALIKE, BANDS, ROWS, PAIRED, BLOCK = 5, 0.8, 25, 6, 16, 128
_MASKS, _FACTORS = np.random.default_rng(13).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)
#: Fingerprints sampled for the upper tree; rows wanted in a shard; most rows of a task's cell.
SAMPLE, SHARD_ROWS, CELL_ROWS = 2048, 32_768, 200_000
#: Pairs that are compared rather than thinned out by a further vantage point.
LEAF = 1 << 18


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[i : i + n] for i in range(min(shingle, len(words))))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, seed) for p in parts), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed long; null texts count as empty."""

    def run(texts: list[str]) -> dict:
        return {"fp": np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, run, "fp long", text_col, (id_col,))


def _far(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(points: np.ndarray, radius: int, rng: np.random.Generator, low: float) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that leave least to compare, neither side under ``low``; None without."""
    best = None
    for v in points[rng.integers(0, len(points), 8)]:
        seen = np.cumsum(np.bincount(_far(points, v), minlength=65 + radius)) / len(points)
        for mu in range(64):
            inside, reached = seen[mu], seen[mu + radius]
            if low <= inside <= 1 - low and (best is None or reached**2 + (1 - inside) ** 2 < best[0]):
                best = (reached**2 + (1 - inside) ** 2, v, mu)
    return None if best is None else best[1:]


def upper_tree(sample: np.ndarray, shards: int, radius: int = RADIUS) -> list | int:
    """Nested [v, mu, inside, outside] over a sample; leaves are shard numbers."""
    rng, numbers = np.random.default_rng(7), iter(range(1 << 30))

    def grow(points: np.ndarray, want: int):
        at = _split(points, radius, rng, 0.3) if want > 1 and len(points) >= 16 else None
        if at is None:
            return next(numbers)
        v, mu = at
        near = _far(points, v) <= mu
        inner = min(want - 1, max(1, round(want * near.mean())))
        return [int(v), int(mu), grow(points[near], inner), grow(points[~near], want - inner)]

    return grow(sample, shards)


def route(tree: list | int, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and shards: each point's own shard and those inside whose boundary it is within ``radius``.

    Two points within ``radius`` of each other are together in one shard at
    least: at every node they are on one side, or the outer one also goes in.
    """
    out: list[tuple] = []

    def walk(node, rows: np.ndarray) -> None:
        if not isinstance(node, list):
            out.append((rows, np.full(len(rows), node, np.int64)))
            return
        v, mu, inside, outside = node
        d = _far(points[rows], np.uint64(v))
        walk(inside, rows[d <= mu + radius])
        walk(outside, rows[d > mu])

    walk(tree, np.arange(len(points)))
    return tuple(np.concatenate(x) for x in zip(*out))


class Groups:
    """Sets of numbers, each known by its least one."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Puts a[i] and b[i] together for every i."""
        up = self.up
        a, b = up[a], up[b]
        apart = a != b
        if not apart.any():
            return
        pairs = np.unique(a[apart] * len(up) + b[apart])
        for i, j in zip((pairs // len(up)).tolist(), (pairs % len(up)).tolist()):
            while up[i] != i:
                i = up[i]
            while up[j] != j:
                j = up[j]
            up[max(i, j)] = min(i, j)
        while (over := up[up] != up).any():
            self.up = up = np.where(over, up[up], up)


def local_links(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, tally: list | None = None) -> np.ndarray:
    """For distinct sorted points the number of the least one that each is connected to.

    ``tally`` takes the numbers of pairs that were compared.
    """
    groups, rng = Groups(len(points)), np.random.default_rng(11)

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, (1 << 18) // len(b))
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(points[a[at : at + step], None] ^ points[b]) <= radius)
            groups.join(a[at : at + step][i], b[j])
        if tally is not None:
            tally.append(len(a) * len(b))

    def meet(a: np.ndarray, b: np.ndarray, alone: bool, left: int) -> None:
        """Every pair of one of a and one of b; ``alone``: a and b are the same, so that a ring only meets itself and those outside it."""
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= leaf or not left:
            compare(a, b)
            return
        sample = points[b[rng.integers(0, len(b), 256)]]
        v = max(sample[:4], key=lambda x: _far(sample, x).std())
        d, e = _far(points[a], v), _far(points[b], v)
        a, b = a[np.argsort(d, kind="stable")], b[np.argsort(e, kind="stable")]
        d, e = np.sort(d), np.sort(e)
        for ring in np.unique(d):
            own = slice(*np.searchsorted(d, (ring, ring + 1)))
            reached = slice(*np.searchsorted(e, (ring if alone else ring - radius, ring + radius + 1)))
            meet(a[own], b[reached], False, left - 1)

    everything = np.arange(len(points))
    meet(everything, everything, True, 16)
    return groups.up


def classes(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, shard_rows: int = SHARD_ROWS, more: DataFrame | None = None) -> DataFrame:
    """(id, fp, component_id): the least id reachable over links of ``radius`` or fewer bits.

    ``prints``: (id, fp) rows; repeats are allowed. ``more``: (x, y) links of
    fingerprints beside those found. Equal fingerprints are one
    row from the first shuffle on, so copies never make pairs.
    """
    spark = prints.sparkSession
    points = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")))
    shards = max(1, -(-points.count() // shard_rows))
    sample = [r.fp for r in points.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect()] if shards > 1 else []
    tree = upper_tree(np.array(sample, np.int64).view(np.uint64), shards, radius) if sample else 0

    def deal(frames):
        for f in frames:
            fp = f.fp.to_numpy(np.int64)
            rows, shard = route(tree, fp.view(np.uint64), radius)
            yield pd.DataFrame({"shard": shard, "fp": fp[rows]})

    dealt = cut(points.select("fp").mapInPandas(deal, "shard long, fp long"))
    # a shard that the tree can't thin out goes to the cells of a block triangle
    large = {r.shard: -(-r.n // CELL_ROWS) for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL_ROWS).collect()}
    parts = F.coalesce(F.create_map(*(F.lit(x) for kv in large.items() for x in kv))[F.col("shard")], F.lit(1)) if large else F.lit(1)
    block = F.pmod(F.xxhash64("fp"), F.col("parts"))
    cells = dealt.withColumn("parts", parts.cast("long")).withColumn("block", block)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def links(f: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(f.fp.to_numpy(np.int64))
        top = local_links(fp.view(np.uint64), radius)
        keep = top != np.arange(len(fp))
        trim()
        return pd.DataFrame({"x": fp[top[keep]], "y": fp[keep]})

    edges = cells.select("shard", "low", "high", "fp").groupBy("shard", "low", "high").applyInPandas(links, "x long, y long")
    groups = connected_components(edges if more is None else edges.unionByName(more))
    groups = groups.join(points.drop("n"), groups.node == points.fp).select("fp", "root", "least")
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "root").select("fp", "component_id")
    named = cut(points.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    # a group of copies is as large as it likes
    return join_counted(prints, named, ["fp"], "n").select(id_col, "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other; texts of
    fewer words than a shingle are one shingle; rows that repeat an id keep
    their number. An empty table gives no rows. Other columns are ignored.
    """
    return classes(cut(fingerprints(docs, id_col, text_col, shingle, seed)), id_col, radius)


def sketch(text: str) -> tuple[int, list[int]]:
    """A hash of the text's set of shingles of ``WORDS`` words, and a key for each band of its least hashes; no keys without words."""
    import xxhash

    hashes = shingle_set(text)
    if not len(hashes):
        return 0, []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        mixed = (hashes[at : at + 1024, None] ^ _MASKS) * _FACTORS
        least = np.minimum(least, mixed.min(axis=0))
    parts = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(parts[i].tobytes(), i) for i in range(BANDS)]
    return xxhash.xxh64_intdigest(hashes.tobytes()), keys


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``WORDS`` words; fewer words are one shingle."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    n = max(1, len(words) - WORDS + 1) if words else 0
    parts = map(b" ".join, zip(*(words[i : i + n] for i in range(min(WORDS, len(words))))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, n))


def in_common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of some sets has in common with each of others; all are sorted and distinct."""
    owner = np.repeat(np.arange(len(others)), list(map(len, others)))
    hashes = np.concatenate([np.empty(0, np.int64), *others])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    out = np.zeros((len(sets), len(others)), np.int64)
    for row, own in zip(out, sets):
        low, n = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
        n -= low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row += np.bincount(owner[at], minlength=len(others))
    return out


def cell_links(f: pd.DataFrame) -> pd.DataFrame:
    """(x, y): a star for each class of a cell's rows (fp, root, block, low, high, hashes), by ``root`` and by alike sets of its two blocks."""
    fp, sets = f.fp.to_numpy(np.int64), [np.sort(np.asarray(h, np.int64)) for h in f.hashes]
    groups = Groups(len(f))
    _, first, root = np.unique(f.root.to_numpy(np.int64), return_index=True, return_inverse=True)
    groups.join(first[root], np.arange(len(f)))
    if len(first) > 1:
        size = np.array(list(map(len, sets)))
        # two of the largest class are together already
        other = root != np.bincount(root).argmax()
        left, right = (f.block == f.low).to_numpy(), (f.block == f.high).to_numpy()
        for a, b in ((left & other, right), (left & ~other, right & other)):
            a, b = np.flatnonzero(a), np.flatnonzero(b)
            both = in_common([sets[i] for i in a], [sets[j] for j in b])
            i, j = np.nonzero(both >= ALIKE * (size[a][:, None] + size[b] - both) - 1e-9)
            groups.join(a[i], b[j])
    keep = groups.up != np.arange(len(f))
    return pd.DataFrame({"x": fp[groups.up[keep]], "y": fp[keep]})


def alike_links(docs: DataFrame, sketched: DataFrame, key: str, text_col: str, radius: int = RADIUS) -> DataFrame:
    """(x, y): fingerprints over ``radius`` bits apart of texts whose sets of shingles have a Jaccard similarity of ``ALIKE`` or more.

    ``sketched``: (key, fp, set, bands) rows. Texts that share a band's key are
    candidates: all pairs of up to ``PAIRED`` distinct sets; in more, first each
    with two that differ from band to band, and then, where that leaves the band
    in several classes, the whole sets in cells of two blocks of ``BLOCK``, each
    of which gives a star. Each candidate's sets are compared whole.
    """
    texts = sketched.groupBy("fp", "set").agg(F.min(F.struct(key, "bands")).alias("x")).select("fp", "set", F.col(f"x.{key}").alias("at"), F.explode("x.bands").alias("band"))
    rows = cut(texts.select("band", F.struct(F.xxhash64("band", "fp", "set").alias("order"), "fp", "at").alias("x")))
    shared = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).filter("n > 1"))
    # beyond what may be broadcast only the few bands of very many rows are, so that none is one task's
    rows = cut(rows.join(F.broadcast(shared), "band") if shared.count() <= FEW else join_counted(rows, shared.withColumn("__n", F.col("n")), ["band"], "__n"))
    few = rows.filter(F.col("n") <= PAIRED).select("band", "x")
    pairs = few.join(few.select("band", F.col("x").alias("y")), "band").select("x", "y")
    many = rows.filter(F.col("n") > PAIRED)
    pairs = pairs.union(many.select("x", F.explode(F.array("low", "high")).alias("y")))
    pairs = pairs.select(F.col("x.at").alias("a"), F.col("y.at").alias("b"), F.col("x.fp").alias("x"), F.col("y.fp").alias("y"))
    low = F.col("x") < F.col("y")
    pairs = pairs.filter("x <> y").select(*(F.when(low, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in ("ab", "ba", "xy", "yx")))
    pairs = cut(pairs.distinct())
    bits = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    near, pairs = pairs.filter(bits <= radius).select("x", "y"), pairs.filter(bits > radius)

    def sets(wanted: DataFrame) -> DataFrame:
        texts = docs.select(key, text_col).join(small(cut(wanted.distinct())), key, "left_semi").dropDuplicates([key])
        return cut(map_texts(texts, lambda ts: {"hashes": [shingle_set(t).view(np.int64) for t in ts]}, "hashes array<long>", text_col, (key,)))

    of = sets(pairs.select(F.explode(F.array("a", "b")).alias(key)))
    pairs = pairs.join(of.select(F.col(key).alias("a"), F.col("hashes").alias("p")), "a").join(of.select(F.col(key).alias("b"), F.col("hashes").alias("q")), "b")
    both = F.size(F.array_intersect("p", "q"))
    links = pairs.filter(both >= ALIKE * (F.size("p") + F.size("q") - both) - 1e-9).select("x", "y").distinct()
    if not many.limit(1).count():
        return links

    links = cut(links)
    groups = connected_components(links.union(near))
    members = many.select("band", "n", "x.fp", "x.at").join(groups, F.col("fp") == groups.node, "left").select("band", "n", "fp", "at", F.coalesce("root", "fp").alias("root"))
    members = cut(members)
    open_bands = cut(members.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("band"))
    cells = members.join(small(open_bands), "band", "left_semi")
    cells = cells.withColumn("parts", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("fp", "at"), F.col("parts")))
    cells = cut(cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    cells = cells.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp", "root", F.col("at").alias(key))
    cells = cells.join(sets(cells.select(key)), key).drop(key)
    return links.union(cells.groupBy("band", "low", "high").applyInPandas(cell_links, "x long, y long"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class, that of the least id; its columns as they are.

    Texts link by SimHash, or by a Jaccard similarity of ``ALIKE`` or more of
    their ``WORDS``-word shingles, which SimHash's few bits mostly miss. Rows
    that share the least id: the one of the least hash of all columns; of equal
    rows one stays. Null ids come last.
    """
    key = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), row_hash(docs).alias("row"))

    def run(texts: list[str]) -> dict:
        sets, bands = zip(*map(sketch, texts))
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return {"fp": signed([fingerprint(t) for t in texts]), "set": signed(sets), "bands": [signed(b) for b in bands]}

    keyed = docs.select(key.alias("__key"), text_col)
    sketched = cut(map_texts(keyed, run, "fp long, set long, bands array<long>", text_col, ("__key",)))
    found = cut(classes(sketched.select("__key", "fp"), "__key", more=alike_links(keyed, sketched, "__key", text_col)))
    gone = small(cut(found.filter("__key <> component_id").select("__key").distinct()))
    left = docs.withColumn("__key", key).join(gone, "__key", "left_anti")
    kept = found.filter("__key = component_id")
    repeats = kept.groupBy("__key").count().filter("count > 1").limit(1).count()
    return (left.dropDuplicates(["__key"]) if repeats else left).select(*quoted(docs.columns))
