"""Trained, pooled and projected vectors against plain ones; times against dateutil; reads by registry."""

import datetime
import math
import random
import re
from collections import Counter

import dateutil.parser
import numpy as np
import pytest
from pyspark.sql import functions as F

from namewarden.functions import names as N
from namewarden.functions.times import parsed_time
from namewarden.operators import subwords, vectors
from namewarden.operators.durable import join_split
from namewarden.plans import documents
from namewarden.sources import sinks

NAMES = ["facebook", "facebook-sdk", "facebook-sdk-test", "meta", "meta-sdk", "meta-sdk-test", "react-native", "react-native-sdk", "python-requests", "requests", "requests-test", "numpy", "numpy-test", "scipy", "scikit-learn", "matplotlib", "matplotlib-pyplot", "pyplot", "vue3x", "vue", "left-pad", "@babel/core", "babel-test", "native", "python", "learn", "sdk", "test", "--", "a"]
#: Pairs of names whose likeness is looked at after training, in order.
PAIRS = [("facebook", "meta"), ("Facebook/SDK", "meta-sdk"), ("facebook-sdk", "meta-sdk"), ("facebook-sdk", "facebook-sdk"), ("facebook-sdk", "meta-sdk"), ("facebook-sdk", "facebook-sdk-test"), ("facebook-sdk", "meta-sdk-test"), ("facebook-sdk", "facebook-sdk-test-test"), ("facebook-sdk", "meta-sdk-test-test"), ("Facebook", "facebook"), ("FACEBOOK", "facebook"), ("face/book", "facebook"), ("face.book", "facebook"), ("face_book", "facebook"), ("react-native", "react_native"), ("ReactNative", "react-native"), ("python-requests", "requests"), ("numpy", "scikit-learn"), ("matplotlib", "matplotlib-pyplot"), ("matplotlib", "matblotlip"), ("matplotlib", "catplotlib"), ("numpy", "scipy")]


def plain_words(name):
    spaced = re.sub(r"([0-9]+)", r" \1 ", re.sub(r"[-_ .~@/:]+", " ", name.lower()))
    return spaced.split()


def plain_units(word):
    padded = f"<{word}>"
    return list(dict.fromkeys(["=" + word, *(padded[i : i + n] for n in range(2, 6) for i in range(len(padded) - n + 1))]))


def plain_vectors(names, dim, columns, bucket):
    """Units' vectors by a dense decomposition."""
    n = Counter()
    for name in set(names):
        w = plain_words(name)
        for i, word in enumerate(w):
            for other in w[max(0, i - 5) : i + 6]:
                for u in plain_units(word):
                    n[u, bucket[other]] += 1
    units = sorted({u for u, _ in n})
    a, at = np.zeros((len(units), columns)), {u: i for i, u in enumerate(units)}
    of_unit, of_column, total = Counter(), Counter(), sum(n.values())
    for (u, c), x in n.items():
        of_unit[u] += x
        of_column[c] += x
    for (u, c), x in n.items():
        a[at[u], c] = max(0, math.log(x * total / (of_unit[u] * of_column[c])))
    left, value, _ = np.linalg.svd(a, full_matrices=False)
    return at, left[:, :dim] * np.sqrt(value[:dim])


def plain_name(name, at, table):
    of_word = lambda w: np.mean([table[at[u]] for u in plain_units(w) if u in at] or [np.zeros(table.shape[1])], axis=0)
    w = plain_words(name)
    if w:
        return np.mean([of_word(x) for x in w], axis=0)
    v = of_word(name)
    return v / np.linalg.norm(v) if np.linalg.norm(v) else v


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.createDataFrame([(n,) for n in [*NAMES, NAMES[0], None]], "package_name string").repartition(3)
    return df, subwords.train(df, dim=12, columns=256, rounds=6)


def test_trained_vectors_are_those_of_a_dense_decomposition(spark, trained):
    df, units = trained
    words = sorted({w for n in NAMES for w in plain_words(n)})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(256)).alias("b")).collect()}
    at, table = plain_vectors(NAMES, 12, 256, bucket)
    got = {r.unit: np.array(r.vector) for r in units.collect()}
    assert set(got) == set(at)
    mine = np.stack([got[u] for u in at])
    # the same up to turns and signs: the same products
    assert mine @ mine.T == pytest.approx(table @ table.T, abs=1e-6)
    asked = [*NAMES, "matblotlip", "zzzz", "...", ""]
    found = {r.package_name: np.array(r.embedding) for r in subwords.name_vectors(spark.createDataFrame([(n,) for n in asked], "package_name string"), units, 12).collect()}
    assert set(found) == set(asked)
    plain = np.stack([plain_name(n, at, table) for n in asked])
    mine = np.stack([found[n] for n in asked])
    assert mine @ mine.T == pytest.approx(plain @ plain.T, abs=1e-6)
    assert not found["zzzz"].any() and not found[""].any()


def test_equal_seeds_train_equal_vectors(spark, trained):
    df, units = trained
    again = {r.unit: r.vector for r in subwords.train(df.repartition(5), dim=12, columns=256, rounds=6).collect()}
    for r in units.collect():
        assert again[r.unit] == pytest.approx(r.vector, abs=1e-9)


def test_sanity_pairs_are_in_order(spark, trained):
    _, units = trained
    every = sorted({x for p in PAIRS for x in p})
    found = {r.package_name: np.array(r.embedding) for r in subwords.name_vectors(spark.createDataFrame([(n,) for n in every], "package_name string"), units, 12).collect()}
    s = [float(found[a] @ found[b] / np.linalg.norm(found[a]) / np.linalg.norm(found[b])) for a, b in PAIRS]
    assert [s[i] for i in (3, 9, 10, 14)] == pytest.approx([1.0] * 4)  # alike, in another case, with another delimiter
    assert s[0] < s[2] < s[3] and s[2] == s[4] == pytest.approx(s[1]) and s[7] < s[5] < s[3]  # one word of two, more words
    assert s[6] < s[5] and s[8] < s[7] and s[0] < s[2]
    assert s[11] == pytest.approx(s[12]) == pytest.approx(s[13]) and s[0] < s[11] < 1  # a delimiter inside a word
    assert s[15] > 0.5 and s[16] > 0.5 and s[18] > 0.5  # words run together, a word more
    assert min(s[19], s[20]) > max(s[17], s[21])  # letters exchanged against other names


def test_names_without_words_train_nothing(spark):
    none = spark.createDataFrame([("-",), (None,)], "package_name string")
    units = subwords.train(none, dim=3, columns=8)
    assert units.count() == 0
    assert [list(r.embedding) for r in subwords.name_vectors(none, units, 3).collect()] == [[0.0] * 3]


@pytest.mark.parametrize("name,registry,want", [("g:a", "maven", ("", "g", "a")), ("g", "maven", ("", "g", "")), ("x", "golang", ("x", "x", "")), ("x/y", "golang", ("x", "x", "y")), ("x/y/z/v2", "golang", ("x", "y", "z/v2")), ("m", "hf", ("", "", "m")), ("a/m/x", "hf", ("", "a", "m/x")), ("left-pad", "npm", None)])
def test_parts_that_are_embedded(spark, name, registry, want):
    got = spark.range(1).select(N.embedding_parts(F.lit(name), F.lit(registry)).alias("x")).first().x
    assert (None if got is None else tuple(got)) == want


def test_three_vectors_of_a_name(spark):
    words = spark.createDataFrame([("alpha", [1.0, 0.0]), ("beta", [0.0, 1.0])], "word string, vector array<double>")
    names = spark.createDataFrame([("alpha/beta-gamma",), ("beta",), (None,), ("alpha/beta-gamma",)], "package_name string")
    got = {r.package_name: tuple(r)[1:] for r in vectors.three_vectors(names, words, 2, "hf").collect()}
    assert got == {"alpha/beta-gamma": ([1 / 3, 1 / 3], [1.0, 0.0], [0.0, 0.5]), "beta": ([0.0, 1.0], [0.0, 0.0], [0.0, 1.0])}
    assert {tuple(r)[2:] for r in vectors.three_vectors(names, words, 2, "npm").collect()} == {(None, None)}


def test_hot_keys_are_joined_without_being_shuffled(spark):
    rows = spark.createDataFrame([(f"k{i % 7 if i < 600 else i}", i) for i in range(3000)] + [(None, -1)], "k string, i int")
    table = spark.createDataFrame([(f"k{i}", i * 2) for i in range(0, 3000, 2)], "k string, x int")
    key = lambda df: Counter(map(tuple, df.select("k", "i", "x").collect()))
    for how in ("left", "inner"):
        assert key(join_split(rows, table, "k", how)) == key(rows.join(table, "k", how))


def test_projections_are_those_of_a_plain_decomposition(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 7)) * [5, 3, 1, 1, 0.5, 0.1, 0.1] + 10
    odd = [(900, None), (901, [float("nan")] * 7), (902, [1.0] * 6), (903, [None] * 7)]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *odd], "id long, v array<double>").repartition(4)
    got = {r.id: r.place for r in vectors.projected(df, "id", "v", 3).collect()}
    centred = x - x.mean(axis=0)
    turn = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :3]
    want = np.abs(centred @ turn)
    assert set(got) == set(range(300)) and np.abs(np.stack([got[i] for i in range(300)])) == pytest.approx(want, abs=1e-8)
    assert vectors.projected(df.filter("id >= 900 and id <> 902"), "id", "v").count() == 0
    assert [r.place for r in vectors.projected(df.filter("id = 5"), "id", "v").collect()] == [[pytest.approx(0), pytest.approx(0)]]


TIMES = ["2021-05-04", "2021-05-04T12:34:56Z", "2021-05-04T12:34:56.789Z", "2021-05-04 12:34:56", "2021-05-04T12:34:56.123456789+02:00", "2021-05-04T12:34:56-0730", "2021-05-04 12:34 UTC", "Tue, 04 May 2021 12:34:56 GMT", "Tue, 4 May 2021 12:34:56 +0200", "04 May 2021", "4-May-2021", "May 4, 2021", "May 4 2021 3:04 PM", "May 4th, 2021, 12:01:02 am", "Tue May 04 2021 12:34:56", "Tue May  4 12:34:56 2021", "5/4/2021", "25/12/2021 10:00", "12/25/2021", "2021/05/04 01:02:03", "20210504", "20210504T123456", "20210504123456", "20210504T123456Z", "2021-02-30", "soon", "", "2021-13-01", "Tuesday, May 4, 2021 11:22:33 PM", "4 Sept 2021", "2021-5-4", "2021-05-04T12:34:56,5Z", "12.05.2021", "2021-05-04T24:00:00", "99/99/2021"]


def test_times_in_many_forms_are_read_as_dateutil_does(spark):
    def plain(text):
        try:
            found = dateutil.parser.parse(text)
        except (ValueError, OverflowError):
            return None
        return (found.astimezone(datetime.timezone.utc) if found.tzinfo else found).replace(tzinfo=None)

    got = spark.createDataFrame([(t,) for t in [*TIMES, None]], "t string").select("t", parsed_time(F.col("t")).cast("string").alias("x")).collect()
    assert {r.t: r.x and datetime.datetime.fromisoformat(r.x) for r in got} == {**{t: plain(t) for t in TIMES}, None: None}
    # script dates: two hours east, whatever a library makes of the sign
    one = spark.range(1).select(parsed_time(F.lit("Tue May 04 2021 12:34:56 GMT+0200 (Central European Time)")).cast("string")).first()[0]
    assert one == "2021-05-04 10:34:56"


def test_only_the_partitions_that_are_asked_for_are_read(spark, tmp_path):
    rng = random.Random(2)
    rows = [(r, f"{r}-{i}", f"doc {i}") for r in ("npm", "pypi", "maven", "nuget") for i in range(50)]
    sinks.write_catalog(spark.createDataFrame(rows, "registry string, package_name string, doc string"), str(tmp_path / "c"))
    catalog = spark.read.parquet(str(tmp_path / "c"))
    asked = [("npm", "NPM-3"), ("npm", "npm-7"), ("pypi", "npm-7"), ("maven", "maven-9"), (None, "x"), ("npm", None), ("npm", "npm-7")]
    rng.shuffle(asked)
    spark.createDataFrame(asked, "registry string, package_name string").write.parquet(str(tmp_path / "asked"))
    requests = spark.read.parquet(str(tmp_path / "asked")).filter("package_name like '%-7' or package_name like '%-3'")
    found = documents.requested(catalog, requests)
    assert sorted(r.package_name for r in found.collect()) == ["npm-3", "npm-7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    nuget = spark.createDataFrame([("nuget-1", "d", "s", "o")], "package_name string, description string, summary string, owners string")
    made = documents.nuget_documents(catalog, nuget)
    assert "(registry" in (plan := made._jdf.queryExecution().executedPlan().toString()) and "PartitionFilters: [isnotnull(registry" in plan
    got = {r.package_name: r.description for r in made.collect()}
    assert len(got) == 50 and got["nuget-1"] == "d" and got["nuget-2"] is None


def test_texts_of_vectors(spark):
    texts = ["[1, -2.5e3]", "[]", "[NaN, Infinity, -Infinity]", "[1, null]", "x", "", None, "{}"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", vectors.parsed(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got[:2] == [[1.0, -2500.0], []] and math.isnan(got[2][0]) and got[2][1:] == [math.inf, -math.inf] and got[3] == [1.0, None] and got[4:7] == [None] * 3
    rows = spark.createDataFrame([([1.5, None, -0.0, 1e-30],), ([],), (None,)], "v array<double>")
    assert [r.w for r in rows.select(vectors.parsed(vectors.written(F.col("v"))).alias("w")).collect()] == [[1.5, None, -0.0, 1e-30], [], None]
