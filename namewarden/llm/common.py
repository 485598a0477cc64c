"""What the corpus operators share: reading, Arrow mapping, checkpoints, words."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewarden.operators.durable import cut, ensure_checkpoints, running, small

__all__ = ["cut", "ensure_checkpoints", "running", "small"]

#: Words are runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Most bytes of an Arrow batch of texts (one row at least), set for the session.
BATCH_BYTES = "4m"

#: Arrow batches are cut into slices of about so many characters of text.
SLICE_CHARS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table; only they are read from the files."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def quoted(names: list[str]) -> list[str]:
    """Column names as they are written in expressions, dots and all."""
    return ["`" + c.replace("`", "``") + "`" for c in names]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; those that hold maps or variants, which have no hash, by their JSON."""
    plain = lambda f: not any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    return F.xxhash64(*(F.col(name) if plain(f) else F.to_json(F.struct(name)) for f, name in zip(df.schema, quoted(df.columns))))


#: Keys that over 1 / HOT of all rows have, so fewer than HOT, are hot.
HOT = 1000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], n: str) -> DataFrame:
    """``rows`` beside the row of ``table`` that has the same ``on``, null for null; ``n`` counts a key's rows and is left out.

    A hot key's rows aren't shuffled to one task: the fewer than ``HOT`` hot
    keys are broadcast, the others joined by a shuffle. ``table`` is
    checkpointed, has one row for every key of ``rows``, and is read thrice.
    """
    other = {c: f"__other_{c}" for c in on}
    table = table.withColumnsRenamed(other)
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    is_hot = F.col(n) * HOT > total
    same = lambda: [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()]
    hot = F.broadcast(table.filter(is_hot).drop(n))
    made = rows.join(hot, same(), "inner").drop(*other.values())
    rest = rows.join(F.broadcast(table.filter(is_hot).select(*other.values())), same(), "left_anti")
    return made.unionByName(rest.join(table.filter(~is_hot).drop(n), same(), "inner").drop(*other.values()))


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    name = "_namewarden_process_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def trim() -> None:
    """Gives a task's freed memory back to the system, where the C library can; an idle worker then stays small."""
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


class Recent(dict):
    """A cache of at most ``most`` entries in two generations: what is used stays, what isn't goes with the older one."""

    def __init__(self, most: int) -> None:
        self.most, self.older = most, {}

    def entries(self, keyed: list[list[str]], make: Callable[[list[str]], Iterable], longest: int) -> list[list]:
        """For each list of keys their entries; ``make`` gives those of keys that have none, and keys up to ``longest`` keep theirs."""
        if len(self) > self.most // 2:
            self.older = dict(self)
            self.clear()
        found = [list(map(self.get, keys)) for keys in keyed]
        missing = {k: self.older.get(k) for keys, got in zip(keyed, found) if None in got for k, x in zip(keys, got) if x is None}
        new = [k for k, x in missing.items() if x is None]
        missing.update(zip(new, make(new)))
        for keys, got in zip(keyed, found):
            if None in got:
                got[:] = [missing[k] if x is None else x for k, x in zip(keys, got)]
        self.update((k, x) for k, x in missing.items() if len(k) <= longest)
        return found


def space_pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Each text cut at its spaces, all pieces in one array, and where each text's begin, with the end; an empty text is one empty piece."""
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    return parts.flatten(), parts.offsets.to_numpy()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``chars`` bytes of ``column``, one row at least."""
    for batch in batches:
        at, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist() if batch.num_rows else []
        for i, n in enumerate(lengths):
            if size and size + n > chars:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)


def map_texts(df: DataFrame, function: Callable[[list[str]], dict], schema: str, column: str = "text", keep: tuple = ()) -> DataFrame:
    """Adds the columns that ``function`` makes from a list of texts (null: empty).

    ``keep`` names the columns to carry; memory is bounded by a batch of
    ``BATCH_BYTES``, a slice of ``SLICE_CHARS`` characters and the longest text.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    made = T._parse_datatype_string(schema)
    # carried under plain names, as any may be in the table
    place = {c: f"__c{i}" for i, c in enumerate(dict.fromkeys((*keep, column)))}
    spec = T.StructType([*(T.StructField(place[c], df.schema[c].dataType) for c in keep), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(spec)
        for part in slices(batches, place[column]):
            new = function([t or "" for t in part.column(place[column]).to_pylist()])
            columns = [part.column(place[c]) for c in keep]
            columns = [a.cast(f.type) for a, f in zip(columns, out)]
            columns += [pa.array(new[f.name], type=out.field(f.name).type) for f in made]
            yield pa.RecordBatch.from_arrays(columns, schema=out)
        trim()

    rows = df.select(*(F.col(q).alias(p) for q, p in zip(quoted(list(place)), place.values())))
    return rows.mapInArrow(run, spec).toDF(*keep, *made.names)
