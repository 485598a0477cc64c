"""The versioned table: changes, readers, writers that die, streams that are rerun."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from namewarden.operators import vectors
from namewarden.operators.catalog import upsert
from namewarden.sources.versions import Taken, Versions, add_packages
from namewarden.streaming import inserts

ROOT = str(Path(__file__).resolve().parents[1])
SCHEMA = "package_name string, updated_at int, created_at int, n int"


@pytest.fixture
def table(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"))
    rows = [(f"p{i}", 1, 1, i) for i in range(40)] + [("p3", 1, 1, 99), (None, 1, 1, 1)]
    assert t.create(spark.createDataFrame(rows, SCHEMA), buckets=8) == 0
    return t


def rows_of(df):
    return sorted(map(tuple, df.select("package_name", "updated_at", "created_at", "n").collect()))


def test_a_change_rewrites_its_buckets_only(spark, table):
    before, old = table.manifest(), rows_of(table.read())
    assert len(old) == 40
    assert table.upsert(spark.createDataFrame([("p7", 5, 5, 70), ("new", 5, 5, 1), ("p8", 0, 0, 80), (None, 5, 5, 1)], SCHEMA)) == 1
    after = table.manifest()
    moved = {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)}
    assert 1 <= len(moved) <= 3 and len({after["folders"][b] for b in moved}) == 1
    want = dict((r[0], r) for r in old) | {"p7": ("p7", 5, 1, 70), "new": ("new", 5, 5, 1), "p8": ("p8", 1, 0, old[[r[0] for r in old].index("p8")][3])}
    assert rows_of(table.read()) == sorted(want.values())
    assert rows_of(table.read(0)) == old and table.numbers() == [0, 1]
    asked = table.named(spark.createDataFrame([("p7",), ("nowhere",)], "package_name string"))
    assert rows_of(asked) == [("p7", 5, 1, 70)]
    files = {f.split("/data/")[1].split("/")[1] for f in asked.inputFiles()}
    assert len(files) <= 2


def test_inserts_ignore_what_is_there_and_removals_what_is_not(spark, table):
    assert table.insert(spark.createDataFrame([("p1", 9, 9, 9), ("x", 9, 9, 9), ("x", 9, 9, 9)], SCHEMA)) == 1
    assert len(rows_of(table.read())) == 41 and ("p1", 1, 1, 1) in rows_of(table.read())
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "package_name string")
    assert table.remove(names("nobody")) is None and table.numbers() == [0, 1]
    assert table.remove(names("x", "p1", "nobody")) == 2
    assert {r[0] for r in rows_of(table.read())} == {f"p{i}" for i in range(40)} - {"p1"}
    every = table.read().select("package_name")
    assert table.remove(every) == 3 and table.read().count() == 0 and table.manifest()["folders"] == {}
    assert table.insert(spark.createDataFrame([("back", 1, 1, 1)], SCHEMA)) == 4 and table.read().count() == 1
    assert len(table.vacuum(1)) >= 3 and table.read().count() == 1 and table.numbers() == [4]


def test_columns_may_be_added_and_maps_are_hashed(spark, table):
    new = spark.createDataFrame([("p1", 5, 5, 1, {"a": 1})], SCHEMA + ", m map<string,int>")
    table.upsert(new)
    assert {r.package_name: r.m for r in table.read().collect() if r.m} == {"p1": {"a": 1}}
    twice = new.union(new.withColumn("n", F.lit(7)))
    assert [r.n for r in upsert(twice, new.limit(0), "package_name").collect()] == [r.n for r in upsert(twice.orderBy("n"), new.limit(0), "package_name").collect()]


def test_a_second_writer_builds_on_the_first(spark, table, monkeypatch):
    """Another writer's version comes between reading and publishing."""
    other, publish, once = Versions(spark, table.path), Versions._publish, []

    def slow(self, manifest):
        if self is table and not once:
            once.append(other.upsert(spark.createDataFrame([("other", 3, 3, 3)], SCHEMA)))
        return publish(self, manifest)

    monkeypatch.setattr(Versions, "_publish", slow)
    assert table.upsert(spark.createDataFrame([("mine", 4, 4, 4)], SCHEMA)) == 2 and once == [1]
    assert {"mine", "other"} <= {r[0] for r in rows_of(table.read())}
    with pytest.raises(Taken):
        table._publish(table.manifest())
    with pytest.raises(Taken):
        table.create(spark.createDataFrame([], SCHEMA))


def test_a_writer_that_is_killed_changes_nothing(spark, table):
    """It dies after its data is written, before its manifest is."""
    script = f"""
        import os, signal, sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        from namewarden.sources.versions import Versions

        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {table.path + "-checkpoints"!r}).getOrCreate()
        table = Versions(spark, {table.path!r})
        table._files.mkdirs(table._path({table.path!r}))
        Versions._publish = lambda self, manifest: os.kill(os.getpid(), signal.SIGKILL)
        table.upsert(spark.createDataFrame([("p1", 9, 9, 9), ("late", 9, 9, 9)], {SCHEMA!r}))
    """
    old, folders = rows_of(table.read()), set(os.listdir(f"{table.path}/data"))
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, timeout=120, env={**os.environ, "PYTHONPATH": ROOT})
    assert done.returncode == -9
    left = set(os.listdir(f"{table.path}/data")) - folders
    assert len(left) == 1 and rows_of(table.read()) == old and table.numbers() == [0]
    assert table.upsert(spark.createDataFrame([("p1", 9, 9, 9)], SCHEMA)) == 1
    assert set(table.vacuum()) == left and ("p1", 9, 1, 9) in rows_of(table.read())


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "package_name string")


def hashed(df):
    return vectors.hashed(df, dim=8)


def test_packages_are_added_with_vectors_of_the_right_length(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "a"))
    t.create(spark.createDataFrame([], "package_name string, embedding array<float>, created_at timestamp, updated_at timestamp"), 4)
    assert add_packages(t, named(spark, "left-pad", "lodash", "lodash", None), hashed, "2025-01-01", {"embedding": 8}) == 1
    with pytest.raises(ValueError, match="8 components"):
        add_packages(t, named(spark, "express"), lambda df: vectors.hashed(df, dim=9), "2025-01-02", {"embedding": 8})
    assert t.numbers() == [0, 1]
    assert add_packages(t, named(spark, "lodash"), hashed, "2025-01-03", {"embedding": 8}) == 2
    got = {r.package_name: (r.created_at.day, r.updated_at.day, len(r.embedding)) for r in t.read().collect()}
    assert got == {"left-pad": (1, 1, 8), "lodash": (1, 3, 8)}


def test_a_stream_that_is_rerun_adds_every_name_once(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "s"))
    schema = "package_name string, embedding array<float>, created_at timestamp, updated_at timestamp"
    t.create(spark.createDataFrame([("known", [0.0] * 8, None, None)], schema), 4)
    source, fail = str(tmp_path / "in"), []

    def arrive(*rows):
        spark.createDataFrame(rows, "package_name string, at string").select("package_name", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(source)

    def then(batch, number):
        if fail:
            fail.clear()
            raise RuntimeError("the driver is lost after the version is published")

    def run():
        stream = spark.readStream.schema("package_name string, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        q = inserts.added(inserts.first_seen(stream, "at"), t, hashed, "arrivals", str(tmp_path / "c"), {"embedding": 8}, then).trigger(availableNow=True).start()
        q.awaitTermination()

    arrive(("a", "2025-01-01 00:00:00"), ("known", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:01:00"), (None, "2025-01-01 00:00:00"))
    run()
    first = {r.package_name: r.created_at for r in t.read().collect()}
    assert set(first) == {"known", "a"}
    arrive(("b", "2025-01-01 01:00:00"), ("a", "2025-01-01 01:00:00"))
    fail.append(True)
    with pytest.raises(Exception, match="driver is lost"):
        run()
    published, after = t.numbers(), {r.package_name: r.created_at for r in t.read().collect()}
    assert set(after) == {"known", "a", "b"}
    run()  # the same batch comes again and finds itself done
    arrive(("c", "2025-01-01 02:00:00"), ("b", "2025-01-05 02:00:00"))
    run()
    again = {r.package_name: r.created_at for r in t.read().collect()}
    assert set(again) == {"known", "a", "b", "c"} and t.read().count() == 4
    assert all(again[k] == v for k, v in after.items()) and all(after[k] == v for k, v in first.items())
    assert t.manifest(published[-1])["streams"]["arrivals"] < t.manifest()["streams"]["arrivals"]
