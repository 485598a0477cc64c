"""Resampling, decontamination and clustering against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import item_rows  # tests/llm/conftest.py
from pyspark.sql import functions as F

from namewarden.llm import clustering, decontamination, resampling
from namewarden.llm.queries import ORACLE_SQL, QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("name", ["op11_resampling", "op12_decontamination", "op13_annulus_clustering"])
def test_queries_equal_sql_on_a_table(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, sf)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    by_name = ", ".join(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(con.sql(f"SELECT {by_name} FROM ({ORACLE_SQL[name]})").fetchall())


# resampling


def plain_resample(rows, target, least=20, percent=25, buckets=10_000, orders=2):
    feats = lambda w: [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own = [[bucket(g) for g in feats(words(t))] for _, t in rows]
    s, t = Counter(b for x in own for b in x), Counter(bucket(g) for x in target for g in feats(words(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (i, text), x in zip(rows, own):
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = place + 1
    return out


@pytest.mark.parametrize("options", [{}, {"orders": 1}, {"orders": 3, "buckets": 50}, {"size": 10_000, "ranked": 7, "percent": 60, "least": 1}])
def test_resampling_equals_the_plain_one(spark, edge, edge_rows, options):
    items = item_rows(edge_rows)
    target = spark.createDataFrame(items, "item_id long, text string, doc_id long, n int")
    named = {k: v for k, v in options.items() if k not in ("size", "ranked")}
    want = plain_resample([r[:2] for r in edge_rows], [t for _, t, *_ in items], **named)
    got = resampling.resample(edge, target, **options).collect()
    assert Counter(map(str, map(tuple, got))) == Counter(str(tuple(r)) for r in want)


def test_resampling_without_a_target_or_documents(spark, edge, edge_rows, nothing):
    want = plain_resample([r[:2] for r in edge_rows], [])
    assert Counter(map(str, map(tuple, resampling.resample(edge, nothing).collect()))) == Counter(str(tuple(r)) for r in want)
    assert resampling.resample(nothing, edge).count() == 0


def test_resampling_deals_texts_once_and_adds_up_where_they_are(spark):
    """Of the table's rows only sums leave a task: one exchange below the window, none of words."""
    rows = spark.createDataFrame([(i, "a b c " * i) for i in range(50)], "doc_id long, text string")
    table = resampling.features(resampling.keyed(rows, "doc_id", "text", 100), 2, 10)
    plan = table.groupBy(*resampling._KEY).count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


# decontamination


def plain_contaminated(rows, items, window=10):
    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    lengths = {len(p) for p in phrases}
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[p]
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((doc, len(w), len(hit), tuple(map(tuple, spans)), tuple(sorted(str(x) for x in found if x is not None))))
    return out


def found_rows(df):
    return [(r.doc_id, r.n_words, r.n_hit, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in df.collect()]


@pytest.mark.parametrize("options", [{}, {"shard": 300, "block": 5}, {"shard": 1000, "piece": 40}, {"window": 2}, {"window": 2, "piece": 7, "shard": 90, "block": 3}])
def test_contaminated_words_are_those_of_the_plain_search(spark, edge, edge_rows, options):
    items = item_rows(edge_rows)
    df = spark.createDataFrame(items, "item_id long, text string, doc_id long, n int")
    want = plain_contaminated([r[:2] for r in edge_rows], [r[:2] for r in items], options.get("window", 10))
    assert Counter(found_rows(decontamination.contaminated(edge, df, **options))) == Counter(want)
    assert sum(bool(r[2]) for r in want) > 6


def test_pieces_cover_a_text_and_overlap():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choices("ab9 .é\n", k=rng.randint(0, 120)))
        want = [w.encode() for w in words(text)]
        piece, overlap = rng.choice([(1000, 9), (7, 2), (12, 9), (3, 0)])
        got = list(decontamination.pieces(text.encode(), piece, overlap, rng.choice([1, 5, 40, 1000])))
        assert all(want[a : a + len(p)] == p and len(p) <= piece for a, p in got)
        assert [a for a, _ in got] == [k * (piece - overlap) for k in range(len(got))] and got[-1][0] + len(got[-1][1]) == len(want)
        assert all(len(p) == piece for _, p in got[:-1]) and (len(got) == 1 or len(got[-1][1]) > overlap)


def test_many_copies_and_passages_in_one_shard(spark):
    rng = random.Random(3)
    body = [rng.choice("abcdefgh") for _ in range(60)]
    rows = [(i, " ".join(body if i % 3 else [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))])) for i in range(300)]
    items = [(i, " ".join(body[i : i + 14])) for i in range(40)] + [(100, "a b"), (101, "h")]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(found_rows(got)) == Counter(plain_contaminated(rows, items))


def test_an_index_orders_searches_and_locates(spark):
    rng = random.Random(1)
    for _ in range(150):
        kinds = rng.choice([1, 2, 3, 20])
        docs = [[rng.randint(1, kinds) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 12))]
        docs += rng.choices(docs, k=rng.randint(0, 4))
        text = np.array([x for d in docs for x in (*d, 0)], np.int32)
        ends = np.flatnonzero(text == 0)
        rest = lambda i: (text[i : ends[np.searchsorted(ends, i)]].tolist(), i)  # noqa: B023, E731
        assert decontamination.suffix_order(text).tolist() == sorted(range(len(text)), key=rest)
        index = decontamination.Index(**decontamination.Index.parts(text, 4))
        size = len(index.start) - 1
        phrases = [[rng.randint(0, size - 1) if size > 1 else 0 for _ in range(rng.randint(1, 6))] for _ in range(20)]
        padded = np.array([[-1] * (6 - len(p)) + p for p in phrases])
        got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(*index.search(padded))}
        for k, p in enumerate(phrases):
            assert got.get(k, []) == [i for i in range(len(text)) if 0 not in p and text[i : i + len(p)].tolist() == p]


def test_decontamination_without_items_or_documents(spark, edge, edge_rows, nothing):
    items = nothing.select(F.col("doc_id").alias("item_id"), "text")
    found = decontamination.decontaminate(edge, items).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert len(found) == len(edge_rows) and all((r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.spans) == (0, 0, none, False, []) for r in found)
    assert decontamination.decontaminate(nothing, items).count() == 0


# clustering


def plain_clusters(rows, n, rounds, dim, scale=64):
    kept = [(i, [max(-clustering.MOST, min(clustering.MOST, math.floor(scale * float(np.float32(x))))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:n]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    within = Counter()
    for _, k, d in out:
        within[k] += d
    return [(i, k, d, within[k], sum(within.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in out]


def odd_vectors(dim, seed, n=120):
    rng = np.random.default_rng(seed)
    rows = [(i * 3 - 20, (rng.normal(size=dim) * rng.choice([0.01, 1, 30])).tolist()) for i in range(n)]
    rows += [(7000 + i, rows[0][1]) for i in range(40)] + [rows[1], rows[1], (None, rows[2][1]), (900, [0.0] * dim), (901, [0.0] * dim)]
    return rows + [(1000, None), (1001, [1.0] * (dim - 1)), (1002, [float("nan")] * dim), (1003, [float("inf")] + [0.0] * (dim - 1)), (1004, [None] + [1.0] * (dim - 1)), (1005, []), (1006, [1e30] * dim), (1007, [-1e30] * dim)]


@pytest.mark.parametrize("dim,n,rounds,seed", [(64, 16, 3, 1), (2, 5, 4, 2), (3, 40, 2, 3), (1, 3, 5, 4), (2, 1000, 2, 5)])
def test_clusters_are_those_of_the_plain_rounds(spark, dim, n, rounds, seed):
    rows = odd_vectors(dim, seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, own string").repartition(3)
    got = clustering.clustered(df, centroids=n, rounds=rounds, dim=dim).collect()
    assert Counter(map(tuple, got)) == Counter(plain_clusters(rows, n, rounds, dim))


def test_the_annulus_prunes_and_keeps_boundary_ties():
    rng = np.random.default_rng(1)
    rows = rng.integers(-400, 400, size=(200, 2))
    centroids, x = clustering.Centroids(rows), rng.integers(-400, 400, size=(3000, 2))
    number, distance, compared = centroids.nearest(x, centroids.nearest_norm(x))
    every = ((x[:, None, :] - rows[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    near, _, again = centroids.nearest(x, number)
    assert (near == number).all() and 4 * again < compared < 200 * 3000
    # on a line through the origin two centroids lie on the annulus' two edges
    line = clustering.Centroids(np.array([[10, 0], [30, 0], [20, 10], [20, -10]]))
    for own in range(4):
        assert line.nearest(np.array([[20, 0]]), np.array([own]))[:2] == (0, 100)


def test_clustering_of_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert clustering.clustered(df).count() == 0


def test_few_rows_over_many_partitions(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, None)], "doc_id long, text string").repartition(20)
    items = spark.createDataFrame([(1, "b c d e f g h i j k"), (2, "zz")], "item_id long, text string").repartition(20)
    assert {(r.doc_id, r.n_hit, r.n_items) for r in decontamination.decontaminate(docs, items).collect()} == {(1, 10, 1), (2, 0, 0)}
    assert {(r.doc_id, r.n_features) for r in resampling.resample(docs, items).collect()} == {(1, 23), (2, 0)}
    rows = [(i, [float(i)] * 64) for i in range(3)]
    got = clustering.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(20)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_clusters(rows, 16, 3, 64))
