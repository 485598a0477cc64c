"""Databases and tables as sources and sinks."""

import uuid

from pyspark.sql import functions as F

from namewarden.sources import readers, sinks

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def test_a_database_is_read_by_ranges_of_a_key(spark):
    """Of the database in memory that Spark brings along."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.createDataFrame([(i * 3 - 50, f"p{i}") for i in range(200)] + [(None, "none")], "id int, package_name string")
    rows.write.format("jdbc").options(url=url, dbtable="packages", driver=DRIVER).save()
    rows.limit(0).write.format("jdbc").options(url=url, dbtable="nothing", driver=DRIVER).save()
    key = lambda df: sorted((r.package_name, r.id) for r in df.collect())
    whole = readers.jdbc(spark, url, "packages", driver=DRIVER)
    parted = readers.jdbc(spark, url, "packages", key="id", parts=5, driver=DRIVER)
    assert key(whole) == key(parted) == key(rows)
    assert (whole.rdd.getNumPartitions(), parted.rdd.getNumPartitions()) == (1, 5)
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID" in parted.filter("id > 500")._jdf.queryExecution().executedPlan().toString().replace("id", "ID")
    assert parted.filter("id > 500").count() == rows.filter("id > 500").count()
    assert readers.jdbc(spark, url, "nothing", key="id", driver=DRIVER).count() == 0


def test_tables_are_replaced_and_dropped(spark, tmp_path):
    name, rows = f"t{uuid.uuid4().hex}", spark.createDataFrame([("npm", "a"), ("pypi", "b")], "registry string, package_name string")
    sinks.save_table(rows, name, str(tmp_path / "one"))
    sinks.save_table(rows.filter("registry = 'npm'"), name, str(tmp_path / "two"))
    assert [tuple(r) for r in spark.table(name).select("registry", "package_name").collect()] == [("npm", "a")]
    sinks.drop_table(spark, name)
    sinks.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)
    assert spark.read.parquet(str(tmp_path / "one")).filter(F.col("registry") == "pypi").count() == 1
