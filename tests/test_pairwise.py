"""All pairs of vectors against brute force, over few and many blocks."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from namewarden.functions import similarity as S
from namewarden.operators import evaluate, pairwise
from namewarden.queries import HYBRID, sim_hybrid


def plain_edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 7 - 40, rng.normal(size=6).tolist(), int(rng.integers(3))) for i in range(130)]
    rows += [(5000, None, 1), (5001, [0.0] * 6, 1), (5002, [float("nan")] * 6, 2), (5003, [1.0, 2.0], 0), (5004, rng.normal(size=6).tolist(), None), (5005, [None] * 6, 2), (rows[0][0], rows[0][1], 1), (None, [1.0] * 6, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def plain(rows):
    """(a, b, s, same) of all pairs."""
    out, rows = [], [(i, v, l) for i, v, l in rows if i is not None]
    for a, x, k in rows:
        for b, y, m in rows:
            if a < b:
                s = 0.0
                if x and y and len(x) == len(y) and None not in x + y:
                    x32, y32 = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                    norm = np.sqrt(x32 @ x32) * np.sqrt(y32 @ y32)
                    s = float(x32 @ y32 / norm) if norm > 0 and np.isfinite(norm) else 0.0
                out.append((a, b, s, None if k is None or m is None else k == m))
    return out


@pytest.mark.parametrize("block", [10, 5000])
def test_all_pairs_by_blocks(spark, vectors, block):
    rows, df = vectors
    want = plain(rows)
    key = lambda x: (x[0], x[1], str(x[3]))
    got = sorted(map(tuple, pairwise.pairs(df, block=block).collect()), key=key)
    assert [(*x[:2], x[3]) for x in got] == [(*x[:2], x[3]) for x in sorted(want, key=key)]
    assert len({(a % 50, b % 50) for a, b, _, _ in got if a % 50 != b % 50}) > 100
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want, key=key)], abs=1e-12)
    low = pairwise.pairs(df, below=-0.3, block=block).collect()
    assert Counter((r.a, r.b) for r in low) == Counter((a, b) for a, b, s, _ in want if s < -0.3)
    levels = {r.level: (r.p, r.n) for r in pairwise.counted(df, lambda s: np.floor(s * 10), -11, 11, block=block).collect()}
    at = Counter((int(np.floor(s * 10)), t) for _, _, s, t in want if t is not None)
    assert levels == {k: (at[k, True], at[k, False]) for k in {k for k, _ in at}}
    known = [(a, b, s, t) for a, b, s, t in want if t is not None]
    for r in pairwise.weights(df, 0.3, block=block).collect():
        hits = Counter((t, s * (r.k * 0.1) + (1 - plain_edits(str(a), str(b)) / 5) * (1 - r.k * 0.1) >= 0.3 - 1e-12) for a, b, s, t in known)
        assert (r.tp, r.fp, r.tn, r.fn) == (hits[True, True], hits[False, True], hits[False, False], hits[True, False])


def test_counted_rows_give_the_same_sweep_and_area(spark):
    rows = [(True, 0.31), (False, 0.31), (True, 0.9), (False, -0.4), (True, 1.0), (False, 0.2)]
    df = spark.createDataFrame(rows, "t boolean, s double")
    few = Counter((int(np.floor(s / 0.01 + 1e-9)), t) for t, s in rows)
    counts = spark.createDataFrame([(k, few[k, True], few[k, False]) for k in {k for k, _ in few}], "level long, p long, n long")
    ordered = lambda x: sorted(map(str, x.select("threshold", "tp", "fp", "tn", "fn").collect()))
    assert ordered(evaluate.sweep(df, "t", "s")) == ordered(evaluate.sweep_counts(counts, "level"))
    assert evaluate.auc(df, "t", "s").first() == evaluate.auc_counts(counts, "level").first()


@pytest.mark.parametrize("block", [9, 5000])
def test_names_are_ids_too(spark, block):
    rng = np.random.default_rng(5)
    names = sorted({"".join(rng.choice(list("abé-"), size=rng.integers(0, 9))) for _ in range(50)} | {"x" * 140, "x" * 139 + "y"})
    rows = [(n, rng.normal(size=3).tolist(), int(rng.integers(2))) for n in names]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int").repartition(3)
    got = {(r.a, r.b): r.s for r in pairwise.pairs(df, block=block).collect()}
    want = {(a, b): float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) for i, (a, x, _) in enumerate(rows) for b, y, _ in rows[i + 1 :]}
    assert got == pytest.approx(want)
    for r in pairwise.weights(df, 0.3, 140.0, block=block).collect():
        hits = Counter((k == m, want[a, b] * (r.k * 0.1) + (1 - plain_edits(a, b) / 140) * (1 - r.k * 0.1) >= 0.3 - 1e-12) for i, (a, _, k) in enumerate(rows) for b, _, m in rows[i + 1 :])
        assert (r.tp, r.fp, r.tn, r.fn) == (hits[True, True], hits[False, True], hits[False, False], hits[True, False])


def test_edits_of_names_that_begin_alike():
    rng = np.random.default_rng(8)
    names = np.array(["".join(rng.choice(list("ab中"), size=rng.integers(0, 7))) for _ in range(90)] + ["", "x" * 140])
    for a, b in ((names, names[::-1]), (np.arange(7, 140), np.arange(95, 110)), (names[:0], names), (np.array([-5, 40, 1234]), np.array([12, 5]))):
        assert pairwise.edits(a, b).tolist() == [[plain_edits(str(x), str(y)) for y in b.tolist()] for x in a.tolist()]
    # a beginning that names share is worked out once
    levels = pairwise.Spelled(np.arange(10_000, 20_000)).of[5][2]
    assert [len(up) for up, _ in levels] == [1, 10, 100, 1000, 10_000]


def test_least_cosines_are_exact():
    for e in range(8):
        for k, x in enumerate(pairwise.least_cosines(e, 0.3, 5.0)):
            hit = lambda s: s * (k * 0.1) + (1 - e / 5.0) * (1 - k * 0.1) >= 0.3 - 1e-12  # noqa: B023, E731
            if np.isfinite(x):
                assert hit(x) and not hit(np.nextafter(x, -9))
            else:
                assert hit(-1.5) == hit(1.5) == (x < 0)


def test_vectors_go_to_few_blocks_as_they_are(spark):
    """Floats stay floats, and a row goes once to each block of many rows."""
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    cells = pairwise._cells(df, "vec_id", "embedding", "label", pairwise.BLOCK)
    assert cells.schema["v"].dataType.elementType.simpleString() == "float"
    assert cells.count() == 20_000 * pairwise.SPREAD
    many = pairwise._cells(df, "vec_id", "embedding", "label", 200)
    assert many.rdd.getNumPartitions() == 5050 and pairwise._cells(df, "vec_id", "embedding", "label", 200, few=True).rdd.getNumPartitions() == 631


@pytest.mark.parametrize(("block", "most"), [(10, 8_000_000), (5000, 8_000_000), (5000, 700), (70, 100)])
def test_pairs_with_edits_come_by_ranges_of_cosines(spark, vectors, block, most):
    rows, df = vectors
    got = pairwise.with_edits(df, block=block, most=most).withColumn("task", F.spark_partition_id()).collect()
    assert Counter((r.a, r.b, round(r.s, 9) + 0.0, r.edits) for r in got) == Counter((a, b, round(s, 9) + 0.0, plain_edits(str(a), str(b))) for a, b, s, _ in plain(rows))
    if block == 5000:
        order = [(round(r.s, 6), r.edits) for r in got]
        assert len({r.task for r in got}) == 1 and order == sorted(order)


@pytest.mark.parametrize("most", [50, 8_000_000])
def test_pairs_of_copies_with_edits(spark, most):
    df = spark.createDataFrame([(f"é{i}" if i else "", [1.0, 2.0] if i < 60 else [-2.0, 1.0], None) for i in range(64)], "vec_id string, embedding array<double>, label int")
    got = pairwise.with_edits(df, most=most).collect()
    assert Counter((r.a, r.b) for r in got) == Counter({tuple(sorted((f"é{i}" if i else "", f"é{j}" if j else ""))): 1 for i in range(64) for j in range(i)})
    assert all(r.edits == plain_edits(r.a, r.b) for r in got)
    assert Counter(round(r.s, 9) for r in got) == {1.0: 60 * 59 // 2 + 6, 0.0: 240}
    assert pairwise.with_edits(df.limit(0)).collect() == [] and pairwise.with_edits(df.limit(1)).collect() == []


def test_files_of_hybrid_scores_are_small(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype("float32").tolist(), 1) for i in range(2000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    sim_hybrid(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1_999_000
    # 24.7 bytes a row in the order of ids
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 16 * 1_999_000


def test_edits_are_worked_out_once_for_all_ranges(monkeypatch):
    rng = np.random.default_rng(9)
    cell = False, *((np.sort(rng.choice(range(k, 9000, 2), 300, replace=False)), np.zeros(300), pairwise.unit(list(rng.normal(size=(300, 8))))[0], np.full(300, 8)) for k in (0, 1))
    asked, plainly = [], pairwise.edits
    monkeypatch.setattr(pairwise, "edits", lambda x, y: asked.append(x.count * y.count) or plainly(x, y))
    a, b, s, e = (np.concatenate(c) for c in zip(*pairwise._in_order(cell, 7000)))
    # 13 ranges, each of which had all pairs' edits before
    assert len(pairwise._ranges(cell, 7000)) == 13 and sum(asked) == 90_000
    assert len({*zip(a.tolist(), b.tolist())}) == 90_000 and (a < b).all()
    first, second = np.where(a % 2, b, a), np.where(a % 2, a, b)
    i, j = np.searchsorted(cell[1][0], first), np.searchsorted(cell[2][0], second)
    assert np.allclose(s, (cell[1][2][i] * cell[2][2][j]).sum(axis=1)) and e.tolist() == plainly(cell[1][0], cell[2][0])[i, j].tolist()


def test_pairs_are_ordered_by_keys():
    rng = np.random.default_rng(10)
    s, e = np.append(rng.choice([-1, 1], 998) * (1 - rng.random(998) * 2e-5), [1 + 4e-16, -1 - 4e-16]), rng.integers(0, 7, 1000).astype(np.int8)
    for bits, most in ((12, 6), (38, 6), (41, 6)):
        keys = np.sort(pairwise._keys(s, e, 5, bits, most))
        at = (keys & ((1 << bits) - 1)) - 5
        assert keys.min() >= 0 and sorted(at.tolist()) == list(range(1000))
        of = [(x, y if bits < 41 else 0) for x, y in zip(np.rint(s[at] * 1e6).tolist(), e[at].tolist())]
        assert of == sorted(of)


def test_hybrid_scores_are_made_in_the_tasks(spark, vectors, tmp_path):
    """As the columns' functions and SQL give them, but not row by row above the tasks."""
    vectors[1].write.parquet(str(tmp_path / "embeddings.parquet"))
    found = sim_hybrid(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "round(" not in plan and "tanh(" not in plan
    columns = pairwise.with_edits(vectors[1]).select("a", "b", F.round("s", 6), F.round(S.hybrid(F.col("edits") / 10, F.col("s")), 6), F.round(S.tanh_hybrid((F.col("s"), 0.4), (F.abs("s"), 0.6)), 6))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, columns.collect()))
    rng = np.random.default_rng(11)
    f = pd.DataFrame({"s": np.concatenate([rng.normal(size=5000) / 4, np.arange(-41, 42) / 2e6, [0.0, 1.0, -1.0]]), "e": rng.integers(0, 7, 5086).astype(np.int8)})
    want = duckdb.sql("SELECT round(s, 6), round(0.5 * s + 0.5 * e / 10, 6), round(0.4 * tanh(2 * s) + 0.6 * tanh(2 * abs(s)), 6) FROM f").fetchall()
    got = {name: of(f.s.to_numpy(), f.e.to_numpy()) for name, of in HYBRID.items()}
    assert [*zip(*(x.tolist() for x in got.values()))] == want and not any((np.signbit(x) & (x == 0)).any() for x in got.values())


def test_cells_with_edits_stay_small(spark):
    df = spark.range(60_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    assert pairwise.with_edits(df).rdd.getNumPartitions() == 55


def test_a_task_has_one_cell(spark):
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    cells = pairwise._cells(df, "vec_id", "embedding", "label", 200).select(F.spark_partition_id().alias("task"), "low", "high").distinct().collect()
    # by a hash 20 of 55 tasks or so had none, and some three or four
    assert sorted(r.task for r in cells) == list(range(55))
    few = pairwise._cells(df, "vec_id", "embedding", "label", 20, few=True).select(F.spark_partition_id().alias("task"), "low", "high").distinct().collect()
    assert max(Counter(r.task for r in few).values()) == -(-5050 // 631)


@pytest.mark.parametrize(("block", "each"), [(10, 300), (5000, 300), (5000, 2_000_000)])
def test_pairs_under_a_cosine_in_order(spark, vectors, block, each):
    rows, df = vectors
    want = sorted((s, a, b) for a, b, s, _ in plain(rows) if s < -0.3)
    found = pairwise.ordered_pairs(df, -0.3, block=block, each=each)
    assert (found.rdd.getNumPartitions() > 4) == (each == 300)
    got = [(r.s, r.a, r.b) for r in found.collect()]
    assert got == sorted(got)
    assert Counter((round(s, 9), a, b) for s, a, b in got) == Counter((round(s, 9), a, b) for s, a, b in want)
    assert pairwise.ordered_pairs(df.limit(0), -0.3).collect() == []


def test_copies_under_a_cosine_are_ordered_by_name(spark):
    df = spark.createDataFrame([(f"é{i}" if i else "", [1.0, 2.0] if i % 2 else [-1.0, -1.9], None) for i in range(120)], "vec_id string, embedding array<double>, label int")
    got = [(r.a, r.b) for r in pairwise.ordered_pairs(df, -0.3, block=50, each=100).collect()]
    names = [(f"é{i}" if i else "", i % 2) for i in range(120)]
    assert got == sorted((a, b) for a, m in names for b, n in names if a < b and m != n)


def test_found_pairs_take_few_bytes_to_shuffle():
    rng = np.random.default_rng(6)
    x, y, s = np.sort(rng.integers(0, 100_000, 20_000)), rng.integers(0, 100_000, 20_000), -0.3 - rng.random(20_000) / 10
    packed = pairwise._packed(np.diff(x, prepend=0), y, s)
    # 16 bytes, compressed, as rows of their own
    assert len(packed) < 10.5 * len(x)
    back = pairwise._unpacked(packed, np.int64, np.int64, np.float64)
    assert [np.cumsum(back[0]).tolist(), back[1].tolist(), back[2].tolist()] == [x.tolist(), y.tolist(), s.tolist()]
