"""Splits, measures, neighbours and rules against values worked out by hand or by brute force."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namewarden.functions import edit
from namewarden.functions import names as N
from namewarden.functions import similarity as S
from namewarden.operators import benignity as B
from namewarden.operators import evaluate as E
from namewarden.operators import neighbors as J
from namewarden.operators import popular as P
from namewarden.plans import detect as D
from namewarden.sources import readers
from namewarden.streaming import arrivals

# a, b, Levenshtein, OSA, edit, bigram, look-alike, parts
MEASURES = [
    ("matplotlip", "matplotlib", 1, 1, 1.0, 0.8, 0.99, 0.585),
    ("reqeust", "request", 2, 1, 1.0, 0.3333, 0.98, 0.0),
    ("l0dash", "lodash", 1, 1, 1.0, 0.4286, 1.0, 0.4333),
    ("abc", "abcdef", 3, 3, 0.5, 0.4, 1.03, 0.85),
    ("abcdef", "abc", 3, 3, 0.5, 0.4, 0.97, 0.85),
    ("react-native", "react_native", 1, 1, 1.0, 0.6923, 0.99, 1.0),
    ("global_do", "global", 3, 3, 0.6667, 0.625, 0.97, 0.6571),
    ("python-requests", "requests", 7, 7, 0.5333, 0.5, 0.0, 0.5727),
    ("numpy", "scipy", 3, 3, 0.4, 0.1429, 0.97, 0.0),
    ("abc", "", 3, 3, 0.0, 0.0, 0.97, 0.0),
    ("a", "b", 1, 1, 1.0, 0.0, 0.99, 0.0),
]


def test_measures(spark):
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([r[:2] for r in MEASURES], "a string, b string")
    got = df.select(F.levenshtein(a, b), S.distance(a, b), S.edit_similarity(a, b), S.bigram_similarity(a, b), S.lookalike_similarity(a, b), edit.parts_col(a, b)).collect()
    for row, want in zip(got, MEASURES):
        assert tuple(row) == pytest.approx(want[2:], abs=6e-5), want


def test_distance_is_alignment():
    assert edit.osa("ca", "abc") == 3 and edit.osa("ab", "ba") == 1
    assert edit.partial_ratio("test", "a test!") == 1.0 and edit.partial_ratio("", "a") == 0.0
    assert edit.soundex("Robert") == edit.soundex("Rupert") == "R163" and edit.phonetic("night", "nite") >= 0.5


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_distance_bounds(a, b):
    d = edit.osa(a, b)
    assert d == edit.osa(b, a) and (d == 0) == (a == b) and d <= max(len(a), len(b))
    assert 0 <= edit.parts_similarity(a, b) <= 1 and 0 <= edit.partial_ratio(a, b) <= 1


def test_splits(spark):
    cases = [("@babel/core", "npm", "babel", "@babel", "core"), ("lodash", "npm", None, None, "lodash"), ("org.apache.foo:bar", "maven", "org.apache.foo", "org.apache.foo", "bar"), ("a:b:c", "maven", None, None, None), ("github.com/Redis/go-redis/v9", "golang", "github.com", "redis", "go-redis"), ("requests", "pypi", None, None, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "n string, r string")
    got = df.select(N.namespace(F.col("n"), F.col("r")), N.name_parts(F.col("n"), F.col("r"))).collect()
    for row, c in zip(got, cases):
        assert row[0] == c[2] and ((None, None) if row[1] is None else (row[1]["group"], row[1]["package"])) == c[3:], c
    assert got[2][1]["domain"] == "org.apache" and got[4][1]["rest"] == "v9"
    one = spark.range(1).select(N.tokens_served(F.lit("vue3x")), N.tokens_trained(F.lit("vue3x")), N.pypi_normal(F.lit("A__b.C"))).first()
    assert tuple(one) == (["vue3", "x"], ["vue", "3", "x"], "a-b-c")


def test_blocking_equals_brute_force(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "package_name string")
    got = {tuple(r) for r in J.within_two_edits(df.withColumnRenamed("package_name", "q"), df, "q", "package_name").collect()}
    want = {(r.a, r.b) for r in df.select(F.col("package_name").alias("a")).crossJoin(df.select(F.col("package_name").alias("b"))).filter("levenshtein(a, b) < 3").collect()}
    assert got == want


def test_risk_score_all_flags(spark):
    points = {"adv": 8, "act": -1, "obv": -18, "fork": -2, "test": -5, "dist": -18, "ov": -18, "rel": -18}
    flags = ["adv", "sus", "nr", "comp", "act", "obv", "fork", "test", "dist", "known", "ov", "rel"]
    rows = list(itertools.product([False, True], repeat=12))
    df = spark.createDataFrame(rows, ", ".join(f"{f} boolean" for f in flags))
    for r in df.withColumn("s", B.risk_score(*map(F.col, flags))).collect():
        want = sum(v for k, v in points.items() if r[k]) + (0 if r.comp else 2) + (10 if r.sus and not r.nr else 3 if r.nr else 0) - (18 if r.known and not r.sus else 0)
        assert r.s == max(0, min(10, want))


def test_stored_metrics_follow_from_counts(spark):
    cells = [(178, 507, 752, 122), (4, 17, 1223, 296), (80, 72, 391, 56), (0, 72, 391, 0), (80, 0, 0, 56), (386, 0, 0, 57)]
    want = [(0.2599, 0.5933, 0.3614, 0.5965), (0.1905, 0.0133, 0.0249, 0.7968), (0.5263, 0.5882, 0.5556, 0.7863), (0, 0, 0, 0.8445), (1.0, 0.5882, 0.7407, 0.5882), (1.0, 0.8713, 0.9312, 0.8713)]
    got = E.with_ratios(spark.createDataFrame(cells, "tp long, fp long, tn long, fn long")).select("precision", "recall", "f1", "accuracy").collect()
    for g, w in zip(got, want):
        assert tuple(g) == pytest.approx(w, abs=5.1e-5)


def test_detect_finds_the_squat_and_spares_trusted(spark):
    popular = spark.createDataFrame([("@acme/requests", 9e6), ("@acme/numpy", 8e6)], "package_name string, popularity double")
    queries = spark.createDataFrame([("@acne/requests",), ("@google/numpi",), ("far",)], "package_name string")
    docs = spark.createDataFrame([("@acne/requests", "{}"), ("@acme/requests", "{}")], "name string, doc string")

    def judge(pairs):
        return B.no_judge(pairs).assign(is_adversarial_name=True)

    found = D.detect(queries, popular, docs, "npm", "2025-01-01", judge).collect()
    assert [(r.query, r.package_name, r.risk_score) for r in found] == [("@acne/requests", "@acme/requests", 10)]

    def broken(pairs):
        raise RuntimeError("no judge")

    assert D.detect(queries, popular, docs, "npm", "2025-01-01", broken).count() == 0
    pairs = spark.createDataFrame([("@acne/requests", "@acme/requests")], "query string, package_name string")
    row = D.verify(pairs, docs, "2025-01-01", broken).first()
    assert row.is_false_positive is None and "no judge" in row.error


def test_sources(spark):
    x = spark.createDataFrame([("('t', 'i'): {'i': '1-step D-L dist'}, 0:01:00.5",), ("else",)], "l string").select(readers.tool_line(F.col("l")).alias("x")).collect()
    assert tuple(x[0].x) == ("t", "i", "1-step D-L dist", 60.5) and x[1].x is None
    y = spark.createDataFrame([("a INFO - foo package exists. Potential squat. ['x']",)], "l string").select(readers.squat_line(F.col("l")).alias("x")).first()
    assert tuple(y.x) == ("foo", "'x'")
    assert readers.help_commands("Usage\n\nAll commands:\n    access, adduser,\n    audit\n\nEnd")[:2] == ["access", "adduser"]
    maven = spark.createDataFrame([("g", "a"), ("g", "a")], "group_id string, artifact_id string")
    assert [r.package_name for r in readers.distinct_names(maven).collect()] == ["g:a"]
    with pytest.raises(ValueError):
        readers.names(spark.range(1))


def test_streamed_arrivals_equal_the_batch(spark, tmp_path):
    new = spark.createDataFrame([(1, "reqeust"), (2, "numpyy"), (3, "far-away")], "id long, package_name string")
    listed = spark.createDataFrame([("request",), ("numpy",)], "package_name string")
    want = sorted(map(tuple, arrivals.confusable(new, listed).collect()))
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    q = arrivals.confusable(stream, listed).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM arrived").collect())) == want and len(want) == 2


@pytest.mark.parametrize("registry, doc, want", [
    ("npm", {"name": "", "info": {"name": "i"}, "description": "a  b", "maintainers": [{"name": "m"}, {"name": ""}, None], "authors": {"name": "w"}}, ("i", "Description:a b README:", ["m", "w"])),
    ("pypi", {"info": {"name": "i", "description": "d"}, "maintainers": ["p", ""]}, ("i", "d", ["p"])),
    ("maven", {"n": "n", "d": "d e", "doc": {"a": "g", "maintainers": [{"name": "x"}]}, "repo_metadata": {"owner": "o"}}, ("n", "d e", ["x", "g", "o"])),
    ("nuget", {"info": {"name": "i"}, "summary": "s", "description": "d", "owners": "one"}, (None, "s d", ["one"])),
    ("nuget", {"name": "n", "summary": "s", "owners": None}, ("n", "s", [])),
    ("ruby", {"name": "n", "description": "d", "readme": "r", "maintainers": [{"uuid": "u"}, {"login": "l", "uuid": "v"}], "repo_metadata": {"owner": "o"}}, ("n", "r", ["u", "l", "o"])),
    ("hf", {}, (None, "", [])),
])
def test_fields_of_a_registry(spark, registry, doc, want):
    import json

    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    d, r = F.col("doc"), F.lit(registry)
    assert tuple(df.select(N.document_name(d, r), N.description(d, r), N.maintainers(d, r)).first()) == want


def test_an_unknown_registry_has_no_neighbours(spark):
    from namewarden.plans.detect import neighbours

    rows = spark.createDataFrame([("lodash", 9e6), ("lodahs", 1.0)], "package_name string, popularity double")
    assert neighbours(rows, rows, "npm").count() and not neighbours(rows, rows, "nowhere").count()


def test_names_of_a_batch_are_compared_once_each(spark):
    """Rows with the same name don't each make rows of its parts."""
    new = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, "Lodahs").otherwise("reakt").alias("package_name"))
    found = arrivals.confusable(new, spark.createDataFrame([("lodash",), ("react",), ("LODAHS",)], "package_name string"))
    assert sorted(map(tuple, found.select("id", "target", "edits").collect())) == [(i, "react", 1) if i % 2 else (i, "lodash", 2) for i in range(300)]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_targets_are_compared_part_by_part(spark):
    rows = spark.range(90).select(F.concat(F.lit("n"), "id").alias("package_name"), (F.col("id") * F.col("id")).cast("double").alias("popularity"))
    found = P.narrowed(rows.select("package_name"), rows, "npm", rows=20)
    want = [(f"n{i}", f"n{j}", float(j * j)) for i in range(90) for j in range(90) if i * i < 10000 and j * j >= 10 * i * i]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.rdd.getNumPartitions() == 25
