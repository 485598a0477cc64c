"""Joins of names within a number of edits, by segments that must be shared.

A name is cut into one segment more than there may be edits, so one of them is
whole in any name that near, moved by no more letters than edits before and
behind it allow. Names are joined on a segment, its number and the length of
the name it is of: as many rows for a long name as for a short one. A pair
that shares several segments is kept at the first, so none is repeated.

Segments of short names are in too many others. Tables of names first lose what
begins or ends all names of a group, which edits can't depend on; what is short
then is joined on what remains without some letters, the same for both names if
they are that near.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewarden.operators.durable import cut, small

#: Pairs of a group that are compared directly; letters of a name that is joined without some of them instead of on segments; names of a task that makes rows of them.
DIRECT, SHORT, NAMES = 250_000, 12, 4096


def places(most: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift) of what names within ``most`` edits may share."""
    return [(d, i, s) for d in range(-most, most + 1) for i in range(most + 1) for s in range(-((most + d) // 2), (most - d) // 2 + 1)]


def span(size: Column, i: Column, most: int) -> tuple[Column, Column]:
    """Where segment ``i`` of a name of so many letters begins, from 0, and how long it is; the last ones are longer."""
    base = F.floor(size / (most + 1)).cast("int")
    later = i - (F.lit(most + 1) - size % (most + 1))
    return i * base + F.greatest(later, F.lit(0)), base + (later >= 0).cast("int")


def segments(name: Column, most: int) -> Column:
    """array of (size, i, text): a name's segments."""
    size = F.length(name)

    def one(i: int) -> Column:
        start, n = span(size, F.lit(i), most)
        return F.struct(size.alias("size"), F.lit(i).alias("i"), F.substring(name, start + 1, n).alias("text"))

    return F.array(*map(one, range(most + 1)))


def _listed(most: int) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for k, (d, i, s) in enumerate(places(most))))


def probes(name: Column, most: int) -> Column:
    """array of (size, i, text, k): what a name within ``most`` edits may have as its segments; k is the place's number."""
    n = F.length(name)

    def one(x: Column) -> Column:
        start, length = span(n + x["d"], x["i"], most)
        at = start + x["s"]
        ok = (n + x["d"] >= 0) & (at >= 0) & (at + length <= n)
        return F.when(ok, F.struct((n + x["d"]).alias("size"), x["i"].alias("i"), F.substring(name, at + 1, length).alias("text"), x["k"].alias("k")))

    return F.filter(F.transform(_listed(most), one), lambda x: x.isNotNull())


def first_shared(a: Column, b: Column, most: int) -> Column:
    """The number of the first place at which ``a`` holds a segment of ``b``."""
    n, size = F.length(a), F.length(b)

    def shares(x: Column) -> Column:
        start, length = span(size, x["i"], most)
        at = start + x["s"]
        return (n + x["d"] == size) & (at >= 0) & (at + length <= n) & (F.substring(a, at + 1, length) == F.substring(b, start + 1, length))

    return F.get(F.filter(_listed(most), shares), F.lit(0))["k"]


def _sharing(asked: DataFrame, listed: DataFrame, a: str, b: str, most: int, on: Sequence[str], hint: str | None = None) -> DataFrame:
    """Rows of both within ``most`` edits, once for each place that they share; __k is the place's number. ``hint`` names the way to join."""
    x = asked.withColumn("__x", F.explode(probes(F.col(a), most))).select(*asked.columns, F.col("__x.size").alias("__size"), F.col("__x.i").alias("__i"), F.col("__x.text").alias("__text"), F.col("__x.k").alias("__k"))
    y = listed.withColumn("__y", F.explode(segments(F.col(b), most))).select(*listed.columns, F.col("__y.size").alias("__size"), F.col("__y.i").alias("__i"), F.col("__y.text").alias("__text"))
    y = y.hint(hint) if hint else y
    return x.join(y, [*on, "__size", "__i", "__text"]).filter(F.levenshtein(a, b, most) >= 0).drop("__size", "__i", "__text")


def near(asked: DataFrame, listed: DataFrame, a: str, b: str, most: int, on: Sequence[str] = ()) -> DataFrame:
    """Rows of both, equal in ``on``, whose names are within ``most`` edits, case and all; each pair of rows once.

    The sides have no other columns in common. It keeps no state, so ``asked``
    may be a stream. Null names are near nothing.
    """
    pairs = _sharing(asked, listed, a, b, most, on)
    return pairs.filter(F.col("__k") == first_shared(F.col(a), F.col(b), most)).drop("__k")


def fewer_letters(name: Column, most: int) -> Column:
    """array of hashes: of a name without up to ``most`` of its letters."""

    def without_one(s: Column) -> Column:
        cut_at = lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
        return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), cut_at)).otherwise(F.array().cast("array<string>"))

    levels = [F.array(name)]
    for _ in range(most):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], without_one))))
    return F.array_distinct(F.transform(F.concat(*levels), lambda s: F.xxhash64(s)))


def _shared_length(x: Column, y: Column) -> Column:
    """How many letters two names begin with alike."""
    n = F.least(F.length(x), F.length(y))
    alike = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i))
    return F.when(n > 0, F.size(alike)).otherwise(0)


def _stripped(x: DataFrame, y: DataFrame, a: str, b: str, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both with __s, the name without what all names of its group begin and end with; the least and the greatest name tell."""
    names = x.select(*on, F.col(a).alias("__n")).unionByName(y.select(*on, F.col(b).alias("__n")))
    r = F.reverse("__n")
    ends = names.groupBy(*on).agg(F.min("__n").alias("l"), F.max("__n").alias("h"), F.min(r).alias("rl"), F.max(r).alias("rh"), F.min(F.length("__n")).alias("n"), F.count(F.lit(1)).alias("__rows"))
    ends = ends.select(*on, "__rows", _shared_length(F.col("l"), F.col("h")).alias("__from"), "n", _shared_length(F.col("rl"), F.col("rh")).alias("t"))
    ends = cut(ends.select(*on, "__rows", "__from", F.least("t", F.col("n") - F.col("__from")).alias("__less")))  # a row for each group
    tasks = -(-(ends.agg(F.sum("__rows")).first()[0] or 1) // NAMES)
    if on:
        ends = small(ends.drop("__rows"))
        beside = lambda df: df.join(ends, list(on))
    else:
        one = ends.select(F.coalesce("__from", F.lit(0)), F.coalesce("__less", F.lit(0))).first()
        beside = lambda df: df.withColumns({"__from": F.lit(one[0]), "__less": F.lit(one[1])})
    inner = lambda c: F.substring(c, F.col("__from") + 1, F.length(c) - F.col("__from") - F.col("__less"))
    strip = lambda df, c: beside(df).withColumn("__s", inner(F.col(c))).drop("__from", "__less").repartition(tasks)
    return strip(x, a), strip(y, b)


def _near_names(x: DataFrame, y: DataFrame, a: str, b: str, most: int, on: Sequence[str], short: int) -> DataFrame:
    """(*on, a, b) of the pairs within ``most`` edits, each once; joins are shuffled, as a row becomes many."""
    x, y = _stripped(x, y, a, b, on)
    # pairs of a short b
    keys = lambda df, c: df.select(*on, c, F.col("__s").alias(f"__s_{c}"), F.explode(fewer_letters(F.col("__s"), most)).alias("__key"))
    some = keys(x.filter(F.length("__s") <= short + most), a).join(keys(y.filter(F.length("__s") <= short), b).hint("merge"), [*on, "__key"])
    some = some.filter(F.levenshtein(f"__s_{a}", f"__s_{b}", most) >= 0).select(*on, a, b)
    # those of a long b
    asked = x.filter(F.length("__s") > short - most).withColumnRenamed("__s", "__s_a")
    listed = y.filter(F.length("__s") > short).withColumnRenamed("__s", "__s_b")
    return some.unionByName(_sharing(asked, listed, "__s_a", "__s_b", most, on, "merge").select(*on, a, b)).distinct()


def names_near(left: DataFrame, right: DataFrame, a: str, b: str, most: int, on: Sequence[str] = (), direct: int = DIRECT, short: int = SHORT) -> DataFrame:
    """(*on, a, b) of the distinct names that are within ``most`` edits, equal in ``on``.

    Names of equal keys that make up to ``direct`` pairs are compared as they
    are; only those of larger groups are joined on what near names share.
    """
    on = list(on)
    distinct = lambda df, c: df.select(*on, c).filter(F.col(c).isNotNull()).distinct()
    x, y = distinct(left, a), distinct(right, b)
    if not on:
        return _near_names(x, y, a, b, most, on, short)
    count = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    large = cut(count(x, "__n").join(count(y, "__m"), on).filter(F.col("__n") * F.col("__m") > direct).select(*on))
    if not large.limit(1).count():
        return x.join(y, on).filter(F.levenshtein(a, b, most) >= 0)
    keys = small(large)
    few = x.join(keys, on, "left_anti").join(y, on).filter(F.levenshtein(a, b, most) >= 0)
    return few.unionByName(_near_names(x.join(keys, on, "left_semi"), y.join(keys, on, "left_semi"), a, b, most, on, short))
