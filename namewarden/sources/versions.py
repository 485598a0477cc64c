"""A table of packages by key in numbered versions.

Rows lie in buckets by a hash of their key. A change writes the buckets that it
touches to a new folder and then a manifest, a small file that names the folder
of every bucket, under the next number; a rename puts it in place whole or not
at all, and fails if that number is taken, in which case the change is made
anew on what the other writer left. A reader takes the last manifest there is,
so it sees the table before a change or after it, and a writer that dies in
between leaves nothing but a folder that no manifest names.

The file system must rename without overwriting, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewarden.operators.catalog import insert_ignore, upsert
from namewarden.operators.durable import cut

#: Buckets of a new table; attempts when other writers come first.
BUCKETS, ATTEMPTS = 64, 5


class Taken(Exception):
    """Another writer has published that version."""


class Versions:
    """A table at ``path``; ``key`` is a column without nulls or repeats."""

    def __init__(self, spark: SparkSession, path: str, key: str = "package_name") -> None:
        self.spark, self.path, self.key = spark, path, key
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        at = self._path(path)
        self._files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._renames = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())

    # manifests

    def numbers(self) -> list[int]:
        """The versions there are."""
        folder = self._path(f"{self.path}/versions")
        if not self._files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._files.listStatus(folder) if f.getPath().getName().endswith(".json") and not f.getPath().getName().startswith("."))

    def manifest(self, number: int | None = None) -> dict | None:
        """A version's manifest, or the last one's; None for a table without any."""
        numbers = self.numbers()
        if not numbers:
            return None
        number = numbers[-1] if number is None else number
        stream = self._files.open(self._path(f"{self.path}/versions/{number:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> int:
        """Puts a manifest in place under its number, or raises ``Taken``."""
        folder = f"{self.path}/versions"
        draft, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{manifest['number']:010d}.json")
        self._files.mkdirs(self._path(folder))
        out = self._files.create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._renames.rename(draft, final, none)
        except Exception as e:
            self._files.delete(draft, False)
            if self._files.exists(final):
                raise Taken(manifest["number"]) from e
            raise
        return manifest["number"]

    # reading

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the last by default; of some buckets only, the others' files aren't looked at."""
        m = self.manifest(number)
        if m is None:
            raise ValueError(f"no table at {self.path}")
        return self._rows(m, buckets)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in manifest["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def named(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        m = self.manifest()
        keys = cut(keys.select(self.key).distinct().withColumn("bucket", self._bucket(m["buckets"])))
        return self._rows(m, self._touched(keys)).join(keys.select(self.key), self.key, "left_semi")

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    @staticmethod
    def _touched(rows: DataFrame) -> list[int]:
        return [r.bucket for r in rows.select("bucket").distinct().collect()]  # as many as buckets

    # changes

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> int:
        """Version 0, of rows without repeats or nulls of the key; raises ``Taken`` if there is a table."""
        if self.numbers():
            raise Taken(0)
        rows = rows.filter(F.col(self.key).isNotNull())
        empty = {"number": 0, "key": self.key, "buckets": buckets, "schema": _nullable(rows.schema).jsonValue(), "folders": {}, "streams": {}}
        return self._publish(self._written(empty, rows.dropDuplicates([self.key]), list(range(buckets))))

    def _written(self, manifest: dict, rows: DataFrame, touched: list[int]) -> dict:
        """The manifest with the touched buckets' rows in a new folder; a bucket that has none left has no folder."""
        folder = uuid.uuid4().hex
        placed = rows.withColumn("bucket", self._bucket(manifest["buckets"]))
        placed.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        found = {f.getPath().getName()[len("bucket=") :] for f in self._files.listStatus(self._path(f"{self.path}/data/{folder}")) if f.getPath().getName().startswith("bucket=")}
        kept = {b: f for b, f in manifest["folders"].items() if int(b) not in set(touched)}
        return {**manifest, "folders": kept | {b: folder for b in sorted(found, key=int)}}

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, batch: int | None = None) -> int | None:
        """Replaces the buckets that keys of ``rows`` lie in by ``merge`` of their rows and the new ones, and tells the new version.

        A ``batch`` of a named ``stream`` is recorded with the version; one that
        was recorded before changes nothing, which gives None, as do no rows.
        Rows with a null key are left out.
        """
        m = self.manifest()
        if m is None:
            raise ValueError(f"no table at {self.path}")
        new = cut(rows.filter(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket(m["buckets"])))
        touched = self._touched(new)
        for attempt in range(ATTEMPTS):
            if batch is not None and m["streams"].get(stream, -1) >= batch:
                return None
            if not touched and batch is None:
                return None
            merged = merge(self._rows(m, touched), new.drop("bucket"))
            columns = T.StructType.fromJson(m["schema"]).names
            added = [f for f in merged.schema if f.name not in columns]
            schema = _nullable(T.StructType([*T.StructType.fromJson(m["schema"]), *added]))
            after = {**m, "number": m["number"] + 1, "schema": schema.jsonValue(), "streams": {**m["streams"], stream: batch} if batch is not None else m["streams"]}
            if touched:
                after = self._written(after, merged.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema)), touched)
            try:
                return self._publish(after)
            except Taken:
                if attempt + 1 == ATTEMPTS:
                    raise
                m = self.manifest()
        return None

    def upsert(self, rows: DataFrame, updated: str = "updated_at", created: str = "created_at", **of_stream) -> int | None:
        """New rows take the place of those of their keys if they are as late or later; created stays the earliest."""
        return self.change(rows, lambda old, new: upsert(old, new, self.key, updated, created), **of_stream)

    def insert(self, rows: DataFrame, **of_stream) -> int | None:
        """Adds the rows whose keys aren't there, one for each key."""
        return self.change(rows, lambda old, new: old.unionByName(insert_ignore(old, new, self.key), allowMissingColumns=True), **of_stream)

    def remove(self, keys: DataFrame) -> int | None:
        """Takes out the rows of some keys; None, and no new version, if none of them is there."""
        m = self.manifest()
        if m is None or not self.named(keys).limit(1).count():
            return None
        return self.change(keys.select(self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last ``keep`` versions and the folders that these don't name; not while others write."""
        numbers = self.numbers()
        used = {f for n in numbers[-keep:] for f in self.manifest(n)["folders"].values()}
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"{self.path}/versions/{n:010d}.json"), False)
        data = self._path(f"{self.path}/data")
        gone = [f.getPath().getName() for f in self._files.listStatus(data) if f.getPath().getName() not in used] if self._files.exists(data) else []
        for f in gone:
            self._files.delete(self._path(f"{self.path}/data/{f}"), True)
        return gone


def _nullable(schema: T.StructType) -> T.StructType:
    """As files give it back."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def add_packages(table: Versions, names: DataFrame, embed: Callable[[DataFrame], DataFrame], at: str, dims: dict[str, int] | None = None, **of_stream) -> int | None:
    """Adds names with their vectors, or gives names that are there new ones; tells the new version.

    ``embed`` puts vector columns beside (package_name); ``dims`` tells the
    length that a column's vectors must have, null ones aside. One that hasn't
    is a ValueError, and nothing is written. ``at`` is the time of the change.
    """
    rows = embed(names.select(table.key).filter(F.col(table.key).isNotNull()).distinct())
    time = F.lit(at).cast("timestamp")
    rows = cut(rows.withColumns({"created_at": time, "updated_at": time}))
    for column, dim in (dims or {}).items():
        wrong = rows.filter(F.col(column).isNotNull() & (F.size(column) != dim)).select(table.key).limit(1).collect()
        if wrong:
            raise ValueError(f"{column} of {wrong[0][0]} hasn't {dim} components")
    return table.upsert(rows, **of_stream)
