"""Measures of names against plain versions, and what rests on them: six similarities, full scan, detection, negatives, learned weights."""

import random
import string
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from namewarden.config import DELIMITERS
from namewarden.functions import edit
from namewarden.operators import learned, pairwise, vectors
from namewarden.operators import popular as P
from namewarden.plans import detect as D
from namewarden.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_osa(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


def plain_subsequence(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[len(a)][len(b)]


def plain_substring(a, b):
    return max((n for n in range(1, min(len(a), len(b)) + 1) if any(a[i : i + n] in b for i in range(len(a) - n + 1))), default=0)


def plain_partial(a, b):
    if not a or not b:
        return 0.0
    best = lambda s, t: max(2 * plain_subsequence(s, t[max(0, i) : i + len(s)]) / (len(s) + len(t[max(0, i) : i + len(s)])) for i in range(1 - len(s), len(t)))
    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(*sorted((a, b), key=len))


def pairs_of_names(seed, n):
    """Short, long, equal, swapped, beyond ASCII and the basic plane, empty."""
    rng = random.Random(seed)
    out = [("", ""), ("", "abc"), ("é😀", "😀é"), ("ab" * 150, "ba" * 150), ("a" * 64, "a" * 63 + "b"), ("x" * 65, "x" * 66), ("a" * 64, "b" * 300), ("-", "--")]
    for _ in range(n):
        a = "".join(rng.choices("abc1é-", k=rng.choice([2, 5, 9, 20, 63, 64, 65, 70])))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 2)] = rng.choice([[], list("x"), b[i : i + 2][::-1], list("ab")])
        out.append((a, "".join(b)))
    return out


def test_alignments_equal_the_plain_table():
    pairs = pairs_of_names(1, 400)
    want = [plain_osa(a, b) for a, b in pairs]
    assert [edit.osa(a, b) for a, b in pairs] == want == [edit.osa(b, a) for a, b in pairs]
    assert edit.osa_batch(*zip(*pairs)).tolist() == want
    assert edit.osa_batch([], []).tolist() == [] and edit.osa_batch(["a" * 70], ["a" * 69]).tolist() == [1]


def test_substrings_and_subsequences_equal_the_plain_ones():
    for a, b in pairs_of_names(2, 120):
        assert edit.common_substring(a, b) == plain_substring(a, b)
        assert edit._subsequence(a, b) == plain_subsequence(a, b)
    for a, b in pairs_of_names(3, 25)[:20]:
        if len(a) < 70:
            assert edit.partial_ratio(a, b) == pytest.approx(plain_partial(a, b))


def test_a_batch_is_aligned_in_little_time():
    rng = random.Random(4)
    a = ["".join(rng.choices(string.ascii_lowercase, k=20)) for _ in range(20_000)]
    began = time.process_time()
    edit.osa_batch(a, a[::-1])
    assert time.process_time() - began < 3


def test_null_names_have_no_distance(spark):
    rows = [("ab", "ba"), (None, "x"), ("x", None), (None, None), ("", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").select("i", edit.osa_col(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in df.orderBy("i").collect()] == [1, None, None, None, 0]


def plain_six(a, b):
    """The six similarities by their definitions; phonetic keys are tested by hand values."""
    edits, longest = plain_osa(a, b), max(len(a), len(b))
    grams = lambda s: pd.Series([s[i : i + 2] for i in range(len(s) - 1)]).value_counts()
    x, y = grams(a.lower()), grams(b.lower())
    both = sum(min(n, y.get(g, 0)) for g, n in x.items())
    out = {"edit": 0.0 if not a or not b else 1.0 if edits < 3 else 1 - edits / longest, "bigram": both / (x.sum() + y.sum() - both) if min(len(a), len(b)) > 1 else 0.0}
    looks = [("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "b"), ("7", "t"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("i", "l"), ("l", "i")]
    p, q = a.lower(), b.lower()
    if any(o in s and s.replace(o, n) == t for o, n in looks for s, t in ((p, q), (q, p))):
        out["lookalike"] = 1.0
    elif p.startswith(q) or q.startswith(p):
        out["lookalike"] = 1 - (len(p) - len(q)) / 100
    else:
        out["lookalike"] = 1 - sum(c != d for c, d in zip(p, q)) / 100 if len(p) == len(q) else 0.0
    out["partial"] = plain_partial(a, b)
    return out


def plain_parts(a, b):
    import re

    a, b = a.lower(), b.lower()
    left, right = ([p for p in re.split(DELIMITERS, s) if p] for s in (a, b))
    if not left or not right:
        return 0.0
    like = [(i, j, plain_substring(x, y) / max(len(x), len(y))) for i, x in enumerate(left) for j, y in enumerate(right)]
    like = [(left[i], right[j], s) for i, j, s in like if s > 0.5]
    if not like:
        return 0.7 + 0.3 * min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
    score = sum(max(len(x), len(y)) * s for x, y, s in like) / sum(map(len, left + right)) * (1 + 0.3 * len(like) / min(len(left), len(right)))
    if len(like) > 1 and all([side.index(p[k]) for p in like] == sorted(side.index(p[k]) for p in like) for k, side in enumerate((left, right))):
        score += 0.2
    score += sum(0.1 for e in (0, -1) if left[e] in right[e] or right[e] in left[e])
    return min(1.0, score)


def test_six_similarities_equal_their_definitions(spark):
    got = QUERIES["sim_six"](spark, SF).collect()
    assert len(got) > 300
    for r in got[:: max(1, len(got) // 300)]:
        want = plain_six(r.a, r.b) | {"parts": plain_parts(r.a, r.b), "phonetic": edit.phonetic(r.a, r.b)}
        assert {k: r[k] for k in want} == pytest.approx(want), (r.a, r.b)
        assert r.overall == pytest.approx(max(want.values()))


def plain_neighbours(names, listed, least=0.85):
    out = []
    for q in names:
        near = [(plain_osa_free(q, p), p) for p in listed if p.lower() != q.lower()]
        near = sorted((d, p) for d, p in near if d < 3 and d < 2 * len(q) // 3)[:10]
        scored = []
        for _, p in near:
            six = plain_six(q, p) | {"parts": plain_parts(q, p), "phonetic": edit.phonetic(q, p)}
            if max(six.values()) >= least:
                scored.append((max(six.values()), listed[p], p))
        scored.sort(key=lambda x: (-x[0], -x[1], x[2]))
        out += [(q, p, s, n) for n, (s, _, p) in enumerate(scored, 1)]
    return out


def plain_osa_free(a, b):
    """Levenshtein distance in lower case."""
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def squats(spark):
    rng = random.Random(7)
    listed = {"".join(rng.choices("abcdef", k=rng.randint(5, 9))): float(rng.randint(1000, 9_000_000)) for _ in range(40)}
    names = set()
    for n in list(listed) * 3:
        s = list(n)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], ["x"], s[i : i + 1] * 2, ["é"]])
        names.add("".join(s))
    names = sorted((names | set(list(listed)[:8])) - {""})
    return names, listed, spark.createDataFrame([(n,) for n in names], "package_name string"), spark.createDataFrame(list(listed.items()), "package_name string, popularity double")


def test_a_full_scan_equals_the_plain_search(squats):
    names, listed, queries, popular = squats
    got = [(r.query, r.package_name, round(r.overall, 9), r["rank"]) for r in D.full_scan(queries, popular, "npm").collect()]
    want = [(q, p, round(s, 9), n) for q, p, s, n in plain_neighbours([n for n in names if n not in listed], listed)]
    assert sorted(got) == sorted(want) and len(want) > 40


def test_detection_equals_the_plain_rules(spark, squats):
    names, listed, queries, popular = squats
    docs = spark.createDataFrame([(n, "{}") for n in {*names, *listed} if hash_of(n) % 5], "name string, doc string")
    has = {n for n in {*names, *listed} if hash_of(n) % 5}

    def judge(pairs):
        from namewarden.operators.benignity import no_judge

        return no_judge(pairs).assign(is_adversarial_name=[sum(map(ord, q)) % 2 == 0 for q in pairs["query"]])

    want = {}
    for q, p, s, n in plain_neighbours(names, listed):
        if q in listed and not (listed[q] < 10000 and listed[p] >= 10 * listed[q]):
            continue
        want.setdefault(q, []).append((n, p))
    verdicts = {}
    for q, found in want.items():
        for _, p in [f for f in sorted(found) if len(f[1]) >= 3][:2]:
            if q in has and p in has and hash_of(q) % 2 == 0 and q not in verdicts:
                verdicts[q] = (p, q in listed)  # 8 for the name, 2 for bare metadata
    got = {r.query: (r.package_name, r.removed_from_legit) for r in D.detect(queries, popular, docs, "pypi", "2025-01-01", judge).collect()}
    assert got == verdicts and len(got) > 10


def hash_of(name):
    return sum(map(ord, name))


@pytest.mark.parametrize("registry", ["npm", "maven"])
def test_pairs_are_narrowed_as_the_lists_are(spark, registry):
    rng = random.Random(3)
    scale = 20_000 if registry == "npm" else 30
    rows = [(f"p{i}", float(rng.randint(1, scale))) for i in range(60)]
    listed = spark.createDataFrame(rows, "package_name string, popularity double")
    pairs = spark.createDataFrame([(f"p{rng.randrange(70)}", f"p{rng.randrange(70)}") for _ in range(600)], "query string, package_name string").distinct()
    whole = P.narrowed(listed, listed, registry).select("query", "package_name")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(P.far_more_popular(pairs, listed, registry)) == key(pairs.join(whole, ["query", "package_name"], "left_semi"))


def test_negative_pairs_are_unlike_and_not_positive(spark):
    names = spark.createDataFrame([("".join(random.Random(i).choices(string.ascii_lowercase, k=7)),) for i in range(200)], "package_name string")
    known = names.select(F.col("package_name").alias("a")).crossJoin(names.select(F.col("package_name").alias("b"))).filter("a < b and substring(a, 1, 1) = 'q'")
    got = vectors.sampled_negatives(names, known, 300).collect()
    positives = {frozenset(r) for r in known.collect()}
    assert len(got) == 300 == len({(r.a, r.b) for r in got})
    assert all(r.a != r.b and frozenset(r) not in positives and 1 - plain_osa(r.a, r.b) / max(len(r.a), len(r.b)) <= 0.2 for r in got)
    assert got == vectors.sampled_negatives(names.repartition(5), known, 300).collect()


def test_half_precision_rounds_as_numpy_does(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    for r in QUERIES["half_precision"](spark, SF).collect():
        assert np.array_equal(np.array(r.embedding, np.float32), np.array(rows[r.vec_id], np.float32).astype(np.float16).astype(np.float32))


def test_learned_weights_equal_a_plain_regression(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, size=(400, 3)).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2.0, -1.5, 0.3] - 0.4)))).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t), i) for i, (r, t) in enumerate(zip(x, y))], "a double, b double, c double, label double, i int")
    model = learned.fit(df, ["a", "b", "c"], "label")
    w = np.zeros(4)
    design = np.column_stack([x, np.ones(400)])
    for _ in range(50):  # Newton's method, weights penalised by half their squares
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag([1, 1, 1, 0]), design.T @ (p - y) + np.array([*w[:3], 0]))
    assert [*model.coefficients, model.intercept] == pytest.approx(w, abs=1e-4)
    told = {r.feature: r.importance for r in learned.importances(model, df, ["a", "b", "c"]).collect()}
    assert told == pytest.approx({c: np.abs((x[:, i] - x[:, i].mean()) * w[i]).mean() for i, c in enumerate("abc")}, abs=1e-4)
    scored = learned.scored(model, df, ["a", "b", "c"], "label").collect()
    assert sorted(r.probability for r in scored) == pytest.approx(sorted(1 / (1 + np.exp(-design @ w))), abs=1e-4)
    assert sorted(r.learned_score for r in scored) == pytest.approx(sorted(x @ w[:3]), abs=1e-3)
    folds = learned.validated(df, ["a", "b", "c"], "label", "i").collect()
    assert sorted(r.fold for r in folds) == list(range(5)) and sum(r.n for r in folds) == 400 and all(0.5 < r.accuracy < 1 for r in folds)


def test_cells_of_blocks_are_tasks_of_their_own(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(400)], "vec_id long, embedding array<double>, label int")
    assert pairwise._cells(df, "vec_id", "embedding", "label", 20).rdd.getNumPartitions() == 210


def test_similarities_of_given_pairs(spark):
    from namewarden.plans import api

    catalog = spark.createDataFrame([("lodash", [1.0, 0.0]), ("lodahs", [1.0, 1.0]), ("none", None)], "package_name string, embedding array<double>")
    pairs = spark.createDataFrame([(1, "lodash", "lodahs"), (2, "lodash", "none"), (3, "lodash", "far-away"), (3, "lodash", "far-away"), (4, None, "x")], "id int, a string, b string")
    got = sorted(api.similarity(pairs, catalog).collect(), key=lambda r: r.id)
    assert [r.id for r in got] == [1, 2, 3, 3, 4]
    assert got[0].vector_similarity == pytest.approx(0.5**0.5) and got[1].vector_similarity is None
    want = plain_six("lodash", "far-away") | {"parts": plain_parts("lodash", "far-away"), "phonetic": edit.phonetic("lodash", "far-away")}
    assert {k: got[2][k] for k in want} == pytest.approx(want) and got[2].similarity == pytest.approx(max(want.values()))
    assert got[0].similarity == 1.0
    assert [r.vector_similarity for r in api.similarity(pairs).collect()] == [None] * 5


def test_evaluation_by_mode(spark):
    from namewarden.operators import evaluate as E
    from namewarden.plans import api

    truth = spark.createDataFrame([(i, i % 3 == 0 if i < 40 else None) for i in range(45)] + [(None, True)], "key int, label boolean")
    said = spark.createDataFrame([(i, None if i % 7 == 0 else (i * 37 % 100) / 100) for i in range(10, 60)], "key int, score double")
    rows = [(i % 3 == 0, None if i < 10 or i % 7 == 0 else (i * 37 % 100) / 100) for i in range(40)]
    got = api.evaluate(truth, said).first()
    assert (got.tp, got.fp, got.tn, got.fn) == tuple(sum(t == a and ((s or 0) >= 0.5) == b for t, s in rows) for a, b in ((True, True), (False, True), (False, False), (True, False)))
    both = spark.createDataFrame([r for r in rows if r[1] is not None], "label boolean, score double")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(api.evaluate(truth, said, "sweep")) == key(E.sweep(both, "label", "score"))
    assert key(api.evaluate(truth, said, "curve")) == key(E.roc(both, "label", "score"))
    assert key(api.evaluate(truth, said, "area")) == key(E.auc(both, "label", "score"))
    with pytest.raises(ValueError):
        api.evaluate(truth, said, "nothing")


@pytest.mark.parametrize("name,target,want", [
    ("left_pad", "left-pad", "delimiters"), ("@acme/core", "@babel/core", "scope"), ("core", "@babel/core", "scope"), ("pad-left", "left-pad", "order"), ("1odash", "lodash", "lookalike"),
    ("lodahs", "lodash", "typo"), ("loadsh", "lodash", "typo"), ("lodash-utils", "lodash", "addition"), ("pylodash", "lodash", "addition"), ("matplotlib", "matplotlib-pyplot", "omission"),
    ("lodash", "Lodash", None), ("far", "away", None), ("", "x", None), (None, "x", None), ("--", "-", "typo"), ("kathryn", "katherine", "sound"),
])
def test_attack_classes(spark, name, target, want):
    from namewarden.functions.attacks import attack_class

    got = spark.createDataFrame([(name, target)], "a string, b string").select(attack_class(F.col("a"), F.col("b")).alias("x")).first().x
    assert got == want


@pytest.mark.parametrize("registry", ["npm", "golang"])
def test_neighbours_are_ranked_by_similarity_then_popularity(spark, registry):
    """The most popular first among equals: of golang those of the least number, which is 0 for unlisted ones."""
    from namewarden.operators import neighbors as J

    listed = {"alpha": 5.0, "alphb": 5.0, "alphc": 900.0, "alphd": 2.0, "alphabet": 50.0}
    pairs = spark.createDataFrame([("alphx", p, 0.1) for p in [*listed, "alphz", "zzz"]], "query string, package_name string, vector_similarity double")
    popular = spark.createDataFrame(list(listed.items()) + [("alpha", 1.0)], "package_name string, popularity double")
    got = J.scored(pairs, popular, registry).orderBy("rank").collect()
    sims = {p: max((plain_six("alphx", p) | {"parts": plain_parts("alphx", p), "phonetic": edit.phonetic("alphx", p), "v": 0.1}).values()) for p in [*listed, "alphz", "zzz"]}
    of = lambda p: listed.get(p, 0.0)
    sign = 1 if registry == "golang" else -1
    want = sorted((p for p in sims if sims[p] >= 0.85), key=lambda p: (-sims[p], sign * of(p), p))
    assert [r.package_name for r in got] == want and [r.popularity for r in got] == [of(p) for p in want]
    assert [r["rank"] for r in got] == list(range(1, len(want) + 1)) and len(want) >= 5
