"""The written index of vectors against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewarden.operators import vector_index
from namewarden.queries import vector_index_exact, vector_index_probed

SF = "/root/testdata/sf0.01"


def rows_of(seed, n=900, dim=8, centres=25):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    rows = [(i, (middle[rng.integers(centres)] + 0.3 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(5000 + i, rows[0][1]) for i in range(300)]  # one vector many times
    return rows + [(9000, None), (9001, [0.0] * dim), (9002, [float("nan")] * dim), (9003, [None] * dim), (9004, [1.0] * (dim + 1)), (9005, [])]


def plain_nearest(rows, query, top, own=False):
    usable = [(i, np.array(v, float)) for i, v in rows if v and None not in v and len(v) == len(query[1]) and np.isfinite(v).all() and any(v)]
    q = np.array(query[1], float)
    scores = [(-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 12), i) for i, v in usable if own or i != query[0]]
    return [(i, -s) for s, i in sorted(scores)[:top]]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows, path = rows_of(1), str(tmp_path_factory.mktemp("index") / "one")
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    return rows, path, vector_index.build(df, path, "id", "v", rows=100)


def test_the_report_tells_of_the_index(built):
    _, path, report = built
    on_disk = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if not f.startswith((".", "_")))
    assert (report["rows"], report["left_out"]) == (1200, 6) and 1 < report["lists"] <= 34 and report["seconds"] > 0
    assert on_disk <= report["bytes"] <= on_disk + 5000 and report["largest_list"] >= 300


def test_a_long_list_lies_in_several_files(built):
    _, path, report = built
    files = {d: [f for f in names if f.endswith(".parquet")] for d, _, names in os.walk(f"{path}/vectors")}
    assert max(map(len, files.values())) >= report["largest_list"] // 100


@pytest.mark.parametrize("top,block,own", [(5, 4096, False), (5, 50, False), (400, 100, True), (2000, 4096, False)])
def test_without_probes_the_search_is_exact(spark, built, top, block, own):
    rows, path, _ = built
    asked = rows[:40:7] + rows[-6:] + [(-1, rows[3][1]), (5003, rows[0][1])]
    df = spark.createDataFrame(asked, "q long, w array<float>")
    got = {}
    for r in vector_index.Index(spark, path).search(df, "q", "w", top, block=block, own=own).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.similarity))
    for q in asked:
        if q[0] >= 9000:
            assert q[0] not in got
            continue
        found, want = sorted(got[q[0]]), plain_nearest(rows, q, top, own)
        assert [i for _, i, _ in found] == [i for i, _ in want] and [r for r, _, _ in found] == list(range(1, len(want) + 1))
        assert [s for _, _, s in found] == pytest.approx([s for _, s in want], abs=1e-11)


def test_a_search_reads_its_lists_only_and_finds_most(spark, built):
    rows, path, _ = built
    index = vector_index.Index(spark, path)
    asked = [(i, v) for i, v in rows[1:900:9]]
    found = index.search(spark.createDataFrame(asked, "q long, w array<float>"), "q", "w", 5, probes=4)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.id)
    recall = np.mean([len(got[q[0]] & {i for i, _ in plain_nearest(rows, q, 5)}) / 5 for q in asked])
    assert recall >= 0.9
    plan = index.vectors([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "IN (1,2)" in plan.replace("list#", "").replace(" ", " ")


def test_recall_of_the_probed_query(spark):
    """Over vectors that lie nearly alike in all directions, the worst case."""
    exact = {(r.query_id, r.id) for r in vector_index_exact(spark, SF).collect()}
    probed = [(r.query_id, r.id) for r in vector_index_probed(spark, SF).collect()]
    assert len(set(probed) & exact) >= 0.9 * len(exact)


def test_an_index_of_nothing_finds_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, v array<float>")
    assert vector_index.build(none, str(tmp_path / "n"), "id", "v")["rows"] == 0
    some = spark.createDataFrame([(1, [1.0])], "id long, v array<float>")
    assert vector_index.Index(spark, str(tmp_path / "n")).search(some, "id", "v").count() == 0


def test_equal_seeds_give_equal_indexes(spark, built, tmp_path):
    rows, path, _ = built
    vector_index.build(spark.createDataFrame(rows, "id long, v array<float>").repartition(5), str(tmp_path / "two"), "id", "v")
    lists = lambda p: sorted((r.id, r.list) for r in spark.read.parquet(f"{p}/vectors").select(F.col("b").alias("id"), "list").collect())
    assert lists(path) == lists(str(tmp_path / "two"))


def test_every_vector_column_of_a_table_is_indexed(spark, tmp_path):
    rows = [("a/x", [1.0, 0.0], [1.0, 0.0], None), ("b/x", [0.9, 0.1], [0.0, 1.0], [1.0, 1.0]), ("c/x", [0.0, 1.0], None, [1.0, 0.9])]
    table = spark.createDataFrame(rows, "package_name string, embedding array<double>, author_embedding array<double>, package_embedding array<double>")
    told = vector_index.build_all(table, str(tmp_path / "all"))
    assert {c: (t["rows"], t["left_out"]) for c, t in told.items()} == {"embedding": (3, 0), "author_embedding": (2, 1), "package_embedding": (2, 1)}
    found = vector_index.Index(spark, str(tmp_path / "all/package_embedding")).search(table, "package_name", "package_embedding", 1)
    assert {(r.query_id, r.id) for r in found.collect()} == {("b/x", "c/x"), ("c/x", "b/x")}
    assert vector_index.build_all(table.select("package_name"), str(tmp_path / "none")) == {}
