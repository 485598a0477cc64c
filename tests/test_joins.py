"""Joins by edits and by angles against brute force, and their plans."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewarden.operators import angles, edits
from namewarden.operators import neighbors as J


def apart(a, b, most):
    """Levenshtein distance, or more than ``most`` if it is over that: cells off the diagonal by more aren't looked at."""
    far = most + 1
    last = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        row = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            row[j] = i if j == 0 else min(last.get(j, far) + 1, row.get(j - 1, far) + 1, last.get(j - 1, far) + (x != b[j - 1]))
        last = row
    return last.get(len(b), far)


def odd_names(seed, n):
    """Short and long names near one another, some beyond ASCII, an empty one."""
    rng = random.Random(seed)
    out = {"".join(rng.choices("abc", k=rng.randint(0, 8))) for _ in range(n)} | {"", "é", "éa", "中文字", "中文"}
    base = "".join(rng.choices("abcdefgh-", k=240))
    for _ in range(40):
        s = list(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["é"]])
        out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_names_within_some_edits_are_found_once(spark, most):
    names = odd_names(most, 120)
    df = spark.createDataFrame([(n, i % 3) for i, n in enumerate(names)], "n string, k int")
    left, right = df.select(F.col("n").alias("a"), "k"), df.select(F.col("n").alias("b"), "k")
    got = [tuple(r) for r in edits.near(left.drop("k"), right.drop("k"), "a", "b", most).collect()]
    want = [(a, b) for a in names for b in names if abs(len(a) - len(b)) <= most and apart(a, b, most) <= most]
    assert sorted(got) == want
    keyed = [(r.a, r.b) for r in edits.near(left, right, "a", "b", most, ["k"]).collect()]
    of = {n: i % 3 for i, n in enumerate(names)}
    assert sorted(keyed) == [(a, b) for a, b in want if of[a] == of[b]]
    twice = [df.union(df) for df in (left, right)]
    for direct in (0, 8000, 10**9):  # all, one or none of the groups by segments
        assert sorted((r.a, r.b) for r in edits.names_near(*twice, "a", "b", most, ["k"], direct).collect()) == sorted(keyed)
    assert sorted((r.a, r.b) for r in edits.names_near(*twice, "a", "b", most).collect()) == want


@pytest.mark.parametrize("short", [0, 3, 9])
@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_names_that_begin_and_end_alike_are_joined_on_the_rest(spark, most, short):
    names = sorted({f"the-same-{n}-end" for n in odd_names(most + 7, 60)[:60]} | {"the-same--end", "the-same-end"} | {f"the-same-{i}-end" for i in range(90, 130)})
    left, right = (spark.createDataFrame([(n,) for n in names], f"{c} string") for c in "ab")
    want = [(a, b) for a in names for b in names if abs(len(a) - len(b)) <= most and apart(a, b, most) <= most]
    assert sorted(map(tuple, edits.names_near(left, right, "a", "b", most, short=short).collect())) == want
    x, _ = edits._stripped(left, right, "a", "b", [])
    assert {r.a: r["__s"] for r in x.collect()} == {n: n.removeprefix("the-same-").removesuffix("end") if n != "the-same-end" else "" for n in names}


def test_rows_made_of_names_arent_broadcast(spark):
    """Spark counts a table that explodes by what it was before."""
    names = odd_names(1, 50)
    left, right = (spark.createDataFrame([(n,) for n in names], f"{c} string") for c in "ab")
    plan = edits.names_near(left, right, "a", "b", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Broadcast" not in plan


def test_second_vectors_are_looked_at_in_the_same_join(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2).tolist(), rng.normal(size=3).tolist() if i % 9 else None, i % 2) for i in range(120)] + [(500, [1.0, 0.0], [1.0, 2.0], 0), (501, [1.0, 0.0], [0.0, 0.0, 0.0], 0)]
    side = lambda c: spark.createDataFrame(rows, f"{c} long, v array<double>, w array<double>, k int")
    first, second = plain_over([r[:2] + r[3:] for r in rows], [r[:2] + r[3:] for r in rows], 0.6, True), plain_over([(r[0], *r[2:]) for r in rows], [(r[0], *r[2:]) for r in rows], 0.5, True)
    for direct in (0, 10**9):
        got = angles.cosine_over(side("a"), side("b"), 0.6, ["k"], cell=20, rows=30, direct=direct, also=0.5).collect()
        assert Counter((r.a, r.b) for r in got) == Counter(first & second) and len(got) > 100


@pytest.mark.parametrize("rows", [20, 1000])
def test_cosines_of_given_pairs(spark, rows):
    given = [r[:2] for r in some_vectors(6, 70, 4, 5)] + [("v1", [1.0, 0.0, 0.0, 0.0])]
    side = lambda c: spark.createDataFrame(given, f"{c} string, v array<double>").repartition(3)
    ids = sorted({a for a, _ in given})
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i % 3 :: 3]]
    got = angles.cosine_of(spark.createDataFrame(pairs, "a string, b string").repartition(4), side("a"), side("b"), rows).collect()
    want = Counter()
    for a, b in pairs:
        for x in (v for i, v in given if i == a):
            for y in (v for i, v in given if i == b):
                known = x and y and len(x) == len(y) and None not in x + y
                norm = np.linalg.norm(x) * np.linalg.norm(y) if known else 0.0
                want[a, b, round(float(np.dot(x, y) / norm), 9) + 0.0 if norm > 0 else 0.0] += 1
    assert Counter((r.a, r.b, round(r.similarity, 9) + 0.0) for r in got) == want


def test_only_pairs_that_can_be_kept_are_given_vectors(spark):
    pairs = [("abcdefgh", f"abcdefg{c}") for c in "ijklm"] + [("abcdefgh", f"abcdef{c}{c}") for c in "ijklm"] + [("abcdefgh", "ABCDEFGH"), ("ab", "ax")]
    df = spark.createDataFrame(pairs, "query string, package_name string")
    assert sorted(map(tuple, J._first_by_edits(df, 5).collect())) == sorted(pairs[:5])
    assert sorted(map(tuple, J._first_by_edits(df, 6).collect())) == sorted(pairs[:10])


def test_a_long_name_makes_no_more_rows_than_a_short_one(spark):
    df = spark.createDataFrame([("abcdefghij",), ("a" * 20_000,)], "n string").select(F.size(edits.probes(F.col("n"), 2)).alias("p"), F.size(edits.segments(F.col("n"), 2)).alias("s"))
    assert {tuple(r) for r in df.collect()} == {(31, 3)}


def some_vectors(seed, n, dim, centres):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    rows = [(f"v{i}", (middle[rng.integers(centres)] + 0.35 * rng.normal(size=dim)).tolist(), int(rng.integers(3))) for i in range(n)]
    return rows + [("null", None, 0), ("zero", [0.0] * dim, 0), ("nan", [float("nan")] * dim, 1), ("gap", [None] * dim, 1), ("short", [1.0] * (dim - 1), 2), ("short2", [1.0] * (dim - 1), 2), ("empty", [], 1), ("same", rows[0][1], 0), ("same2", rows[0][1], 0)]


def plain_over(left, right, over, keyed):
    out = set()
    for a, x, k in left:
        for b, y, m in right:
            if x and y and len(x) == len(y) and None not in x + y and (not keyed or k == m):
                u, v = np.array(x), np.array(y)
                norm = np.sqrt(u @ u) * np.sqrt(v @ v)
                if norm > 0 and np.isfinite(norm) and u @ v / norm > over:
                    out.add((a, b))
    return out


@pytest.mark.parametrize("over,options", [(0.8, {}), (0.9, {"cell": 20, "rows": 40}), (0.5, {"cell": 25, "rows": 1000, "direct": 50}), (-0.2, {"cell": 60, "rows": 70, "direct": 0}), (0.99, {"cell": 30, "references": 4, "direct": 0})])
@pytest.mark.parametrize("keyed", [False, True])
def test_pairs_over_a_cosine_are_those_of_all_pairs(spark, over, options, keyed):
    left, right = some_vectors(1, 150, 6, 9), some_vectors(1, 220, 6, 9)[40:]
    side = lambda rows, c: spark.createDataFrame(rows, f"{c} string, v array<double>, k int").repartition(3)
    got = angles.cosine_over(side(left, "a"), side(right, "b"), over, ["k"] if keyed else [], **options).collect()
    want = plain_over(left, right, over, keyed)
    assert Counter((r.a, r.b) for r in got) == Counter(want) and len(want) > 50
    known = {i: np.array(v) for i, v, _ in left + right if v}
    assert all(r.similarity == pytest.approx(known[r.a] @ known[r.b] / np.linalg.norm(known[r.a]) / np.linalg.norm(known[r.b]), abs=1e-12) for r in got)


def test_cells_out_of_reach_arent_asked():
    rows = np.array([v for _, v, _ in some_vectors(2, 3000, 8, 40)[:3000]])
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    cells = angles.Cells({8: units[:60]}, 0.9)
    at = angles.angles(units, units[:60])
    for c in range(60):
        mine = at[at.argmin(axis=1) == c, c]
        cells.low[8][c], cells.high[8][c] = mine.min(), mine.max()
    reached = cells.reached(8, units)
    own, s = at.argmin(axis=1), units @ units.T
    assert all(reached[i, own[j]] for i, j in zip(*np.nonzero(s > 0.9)))
    assert reached.mean() < 0.3


def test_an_empty_side_has_no_pairs(spark):
    none = spark.createDataFrame([], "a string, v array<double>")
    assert angles.cosine_over(none, none.withColumnRenamed("a", "b"), 0.5).count() == 0


def test_neighbours_compare_no_two_tables_whole(spark):
    rows = spark.createDataFrame([("lodash", [1.0, 0.1]), ("lodahs", [1.0, 0.0])], "package_name string, embedding array<double>")
    plan = J.flat(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_vectors_decide_among_names_of_one_part(spark):
    """Authors far apart whose vectors are alike are neighbours if the models' vectors are too; a missing part has none."""
    rows = [("alpha/core", [1.0, 0.0], [1.0, 0.0]), ("entirelyelse/core", [1.0, 0.1], [1.0, 0.01]), ("entirelyother/core", [1.0, 0.1], [1.0, 0.5]), ("alphb/core", [0.0, 1.0], [0.0, 1.0]), ("alpha/other", [1.0, 0.0], [1.0, 0.0]), ("alone", [1.0, 0.0], [1.0, 0.0]), ("aline", [1.0, 0.0], [1.0, 0.0]), ("unknown/core", None, None)]
    rows = [("example.com/" + n, *v) for n, *v in rows]
    df = spark.createDataFrame(rows, "package_name string, author_embedding array<double>, package_embedding array<double>")
    got = {(r.query, r.package_name): r for r in J.by_group(df, df, "golang").collect()}
    short = lambda pair: tuple(x.split("/")[1] for x in pair)
    assert {short(p) for p in got if "alpha" in p[0]} == {("alpha", "entirelyelse"), ("alpha", "alphb")}
    assert {short(p) for p in got} == {("alpha", "entirelyelse"), ("entirelyelse", "alpha"), ("alpha", "alphb"), ("alphb", "alpha")}
    no_vectors = df.drop("author_embedding", "package_embedding")
    assert {short((r.query, r.package_name)) for r in J.by_group(no_vectors, no_vectors, "golang").collect()} == {("alpha", "alphb"), ("alphb", "alpha")}
