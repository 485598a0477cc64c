"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sources' targets share all words by weight, none above ``CAP`` times what the
source has. Blocks of ``BLOCK`` words are dealt to sources, and each source's
to its shards, one by one to the highest quotient votes / (2 * seats + 1). In a
shard the documents stand in a seeded order and the shard's quota of blocks is
taken from the front, going round again while it lasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewarden.llm.common import WORD, cut, quoted, running, small
from namewarden.operators.durable import FEW

#: Weights by rank, most times that a document is taken, words of a block, documents wanted in a shard, seed.
WEIGHTS, CAP, BLOCK, SHARD_DOCS, SEED = (1, 2, 3), 3, 16, 4096, 42


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0))


def order_key(id_col: Column, seed: int) -> Column:
    """A hexadecimal digest that orders and shards documents by seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, few: int = FEW) -> DataFrame:
    """(source, source_size, n_docs, rank, target) for rows (source, size).

    Sources by code point, null last, weigh ``weights``, repeating. With the
    sources in ascending order of cap / weight, those before one at their caps
    leave it the level (all - caps) / weights left; the largest such level is
    the one at which nothing is above its cap, and a target is the lesser of
    weight * level and cap.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by = running(by, [], [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, few).withColumn("rank", F.col("rank") + 1)
    by = by.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")))
    by = by.withColumn("most", F.col("source_size") * cap)
    by = running(by, [], [F.col("most") / F.col("w"), F.col("rank")], {"__most": F.col("most"), "__w": F.col("w")}, few)
    by = cut(by)
    all_of = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    by = by.withColumn("level", (F.lit(all_of["size"]) - F.col("__most")) / (F.lit(all_of.w) - F.col("__w")))
    level = by.agg(F.max("level")).first()[0]
    by = by.withColumn("target", F.least(F.lit(level).cast("double") * F.col("w"), F.col("most").cast("double")))
    return by.select("source", "source_size", "n_docs", "rank", "target")


def apportion(parties: DataFrame, within: list[str], party: str, votes: str, seats: Column, total: Column, few: int = FEW) -> DataFrame:
    """(within, party, quota): ``seats`` dealt to parties by Sainte-Laguë, ties to the lesser party.

    ``seats`` and ``total`` (of the votes) are the same for all rows of a
    ``within``. A divisor near total / seats gives all seats, so each party's
    number is known but for a short run of its quotients; only those runs are
    ranked, about three for a party.
    """
    df = cut(parties.withColumns({"__seats": seats, "__total": total, "__all": F.lit(0)}))
    by = within or ["__all"]
    df = df.join(small(cut(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))), few), by)
    df = df.withColumn("__share", F.when(F.col("__total") > 0, F.col(votes) * F.col("__seats") / F.col("__total")).otherwise(0.0))
    reach = F.ceil(F.col("__share") * (F.col("__n") + 1) / (2 * F.greatest("__seats", F.lit(1)))) + 2
    df = df.withColumn("__sure", F.greatest(F.floor("__share") - reach, F.lit(0)).cast("long"))
    df = df.withColumn("__k", F.explode(F.sequence("__sure", (F.floor("__share") + reach).cast("long"))))
    df = df.withColumn("__quotient", F.col(votes) / (2 * F.col("__k") + 1))
    df = df.select(*by, party, "__seats", "__sure", "__k", "__quotient")
    df = cut(running(df, by, [F.col("__quotient").desc(), F.col(party), F.col("__k")], {"__before": F.lit(1)}, few))
    sure = df.filter(F.col("__k") == F.col("__sure")).groupBy(*by).agg(F.sum("__sure").alias("__surely"))
    df = df.join(small(cut(sure), few), by)
    taken = (F.col("__before") < F.col("__seats") - F.col("__surely")) & (F.col("__quotient") > 0)
    return df.groupBy(*within, party).agg((F.min("__sure") + F.sum(taken.cast("long"))).alias("quota"))


def shard_of(key: Column, shards: Column) -> Column:
    """The shard of a digest."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), shards)


def quotas(sized: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of rows (id, source, size).

    (__source, __rank, __shards, source_size, target) of every source, and
    (__of, shard, __cell, __rows, __words) of every shard, __of its source's
    rank: the words and rows that it has and the words that it gives.
    """
    of = targets(sized.select("source", "size"), weights, cap, few).withColumn("shards", F.ceil(F.col("n_docs") / shard_docs))
    of = cut(of)
    sources = small(of.select(F.col("source").alias("__source"), F.col("rank").alias("__rank"), F.col("shards").alias("__shards"), "source_size", "target"), few)
    cells = sized.join(sources, F.col("source").eqNullSafe(F.col("__source")))
    cells = cells.select(F.col("__rank").alias("rank"), shard_of(order_key(F.col("id"), seed), F.col("__shards")).alias("shard"), "size")
    cells = cut(cells.groupBy("rank", "shard").agg(F.sum("size").alias("cell"), F.count(F.lit(1)).alias("rows")))
    all_targets = F.lit(of.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    seats = apportion(of.select("rank", "target"), [], "rank", "target", F.floor(all_targets / block + 0.5), all_targets, few)
    sums = small(cut(seats.join(cells.groupBy("rank").agg(F.sum("cell").alias("words")), "rank")), few)
    per_shard = apportion(cells.join(sums, "rank"), ["rank"], "shard", "cell", F.col("quota"), F.col("words"), few)
    given = cells.join(per_shard, ["rank", "shard"]).select(F.col("rank").alias("__of"), "shard", F.col("cell").alias("__cell"), F.col("rows").alias("__rows"), F.least(F.col("quota") * block, F.col("cell") * cap).alias("__words"))
    return sources, small(cut(given), few)


def placed(docs: DataFrame, key: Column, source: Column, sources: DataFrame, given: DataFrame) -> DataFrame:
    """``docs`` with __key and its source's and its shard's rows."""
    df = docs.withColumn("__key", key).join(sources, source.eqNullSafe(F.col("__source")))
    df = df.withColumn("__shard", shard_of(F.col("__key"), F.col("__shards")))
    return df.join(given, (F.col("__rank") == F.col("__of")) & (F.col("__shard") == F.col("shard")))


def summed_before(df: DataFrame, given: DataFrame, order: list[Column], size: Column, few: int) -> DataFrame:
    """``df`` with __before, the sum of the sizes before a row in its shard; a shard of over ``few`` rows, as null ids make, is summed range by range."""
    if (given.agg(F.max("__rows")).first()[0] or 0) > few:
        return running(df, ["__rank", "shard"], order, {"__before": size}, few)
    line = Window.partitionBy("__rank", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__before", F.coalesce(F.sum(size).over(line), F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: tuple = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED, few: int = FEW) -> DataFrame:
    """``docs`` with source_size, target, shard and taken (words the mix takes, repeats counted).

    Every row stays; rows of size 0 take 0; rows that repeat an id are taken
    apart, those alike in id and size in any order. A shard's quota is taken
    from the front of its seeded order, so the last document of a round may be
    taken in part; no document is taken more than ``cap`` times. Equal seeds
    give equal results. An empty table gives no rows. Columns of ``docs`` named
    as those added give way to them.
    """
    made = ("source_size", "target", "shard", "taken")
    docs = docs.select(*quoted([c for c in docs.columns if c not in made]))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).alias("size"))
    sources, given = quotas(sized, weights, cap, block, shard_docs, seed, few)
    df = placed(docs, order_key(F.col(id_col), seed), F.col(source_col), sources, given)
    df = summed_before(df, given, [F.col("__key"), F.col(id_col), F.col(size_col)], F.col(size_col), few)
    rounds = F.when(F.col("__cell") > 0, F.expr("__words div __cell")).otherwise(0)
    rest = F.when(F.col("__cell") > 0, F.expr("__words % __cell")).otherwise(0)
    taken = rounds * F.col(size_col) + F.least(F.greatest(rest - F.col("__before"), F.lit(0)), F.col(size_col))
    return df.select(*quoted(docs.columns), "source_size", "target", F.col("shard").cast("long").alias("shard"), taken.cast("long").alias("taken"))


def take(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED, few: int = FEW) -> DataFrame:
    """The mix in whole documents, with the columns of ``docs``: each row as often as its words are taken, rounded.

    All is worked out on ids, sources, sizes and a hash of the text. In a
    shard's order the rows up to one are taken once more than those after it,
    so that row's place is all that is joined to the texts, which aren't
    shuffled. Rows alike in id and text are taken alike; a row without words
    isn't taken; a null source is a source, a null id an id. An empty table
    gives no rows.
    """
    row = lambda: F.xxhash64(F.col(text_col))
    slim = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), row().alias("row")))
    sources, given = quotas(slim.select("id", "source", "size"), weights, cap, block, shard_docs, seed, few)
    df = placed(slim, order_key(F.col("id"), seed), F.col("source"), sources, given)
    df = summed_before(df, given, [F.col("__key"), F.col("id"), F.col("row")], F.col("size"), few)
    more = (F.col("__cell") > 0) & (F.col("size") > 0) & (2 * F.expr("(__words % __cell) - __before") >= F.col("size"))
    place = F.struct(F.col("__key").alias("key"), F.col("id"), F.col("row"))
    last = df.groupBy("__of", "shard").agg(F.max(F.when(more, place)).alias("__last"), F.max(F.when(F.col("__cell") > 0, F.expr("__words div __cell")).otherwise(0)).alias("__rounds"))
    df = placed(docs.select(F.struct(*quoted(docs.columns)).alias("__row"), F.col(source_col).alias("__src"), F.col(id_col).alias("__id"), row().alias("__hash"), F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)).alias("__any")).filter("__any"), order_key(F.col("__id"), seed), F.col("__src"), sources, small(cut(last), few))
    once_more = F.coalesce(F.struct(F.col("__key").alias("key"), F.col("__id").alias("id"), F.col("__hash").alias("row")) <= F.col("__last"), F.lit(False))
    times = (F.col("__rounds") + once_more.cast("long")).cast("int")
    return df.select("__row", F.explode(F.array_repeat(F.lit(0), times)).alias("__copy")).select("__row.*")


#: op8 in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST((rank - 1) % 3 + 1 AS INTEGER) AS w, source_size * 3 AS most FROM r),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(most) OVER b AS DOUBLE), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(max(level) OVER () * w, CAST(most AS DOUBLE)) AS target, ceil(n_docs / 4096) AS shards FROM l),
h AS (SELECT *, CAST(floor(sum(target) OVER () / 16 + 0.5) AS BIGINT) AS blocks FROM t),
q1 AS (SELECT h.rank, h.target / (2 * k.k + 1) AS quotient, k.k, h.blocks FROM h, LATERAL (SELECT unnest(range(0, CAST(ceil(h.target / 16) AS BIGINT) * 2 + 25)) AS k) k),
c1 AS (SELECT rank, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, rank, k) AS n FROM q1 WHERE quotient > 0) WHERE n <= blocks GROUP BY rank),
e AS (SELECT d.*, t.rank, t.source_size, t.target, CAST(('0x' || substr(key, 1, 8)) AS BIGINT) % CAST(t.shards AS BIGINT) AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT e.rank, shard, CAST(sum(size) AS BIGINT) AS cell FROM e GROUP BY ALL),
q2 AS (SELECT c.rank, c.shard, c.cell / (2 * k.k + 1) AS quotient, k.k, c1.quota FROM c JOIN c1 USING (rank), LATERAL (SELECT unnest(range(0, c1.quota)) AS k) k),
c2 AS (SELECT rank, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY quotient DESC, shard, k) AS n FROM q2 WHERE quotient > 0) WHERE n <= quota GROUP BY rank, shard),
g AS (SELECT c.*, least(coalesce(c2.quota, 0) * 16, c.cell * 3) AS words FROM c LEFT JOIN c2 USING (rank, shard)),
o AS (SELECT e.*, g.cell, g.words, coalesce(CAST(sum(size) OVER (PARTITION BY e.rank, e.shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
      FROM e JOIN g ON e.rank = g.rank AND e.shard = g.shard)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(CASE WHEN cell > 0 THEN (words // cell) * size + least(greatest(words % cell - before, 0), size) ELSE 0 END AS BIGINT) AS taken FROM o
"""
