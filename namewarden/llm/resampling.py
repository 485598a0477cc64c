"""Importance resampling of documents towards a target's distribution of word n-grams.

A position table has a row for each word of a document (posexplode); a window's
lead() puts the words that follow behind each one, for every order up to
``ORDERS``. The n-grams are hashed into buckets; counted over all documents and
over the target they give each bucket's gain, a join brings the gains back to
the features, and a document's weight is their mean. A seeded Gumbel score,
added to the weight, turns the highest scores into a draw without replacement.

Documents are dealt to tasks by their own key, texts and all, so the table, its
window and the sums of a document need no further shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewarden.llm.common import cut, running

#: Longest n-gram; buckets; least words of a document that may be drawn, percent of these that are; the seed.
ORDERS, BUCKETS, LEAST, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Bytes of text wanted in a task; rows that are ranked in one task; most tasks, which get more of either beyond.
BYTES, ROWS, TASKS = 4_000_000, 20_000, 100_000

_KEY = ("__id", "__hash", "__bytes", "__row")


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lowered; none for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def keyed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The key columns and text of every row, rows dealt by the key but for its row number.

    A row's place in its partition tells rows alike apart; where a lost
    partition's rows come back in another order, those are rows alike.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__hash"), F.octet_length(text).alias("__bytes"), F.monotonically_increasing_id().alias("__row"), F.col(text_col).alias("__text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return rows.repartition(max(1, min(TASKS, -(-total // size))), *_KEY[:3])


def features(rows: DataFrame, orders: int, buckets: int) -> DataFrame:
    """(key, word, bucket): a row for each n-gram; a document without words has one, of nulls.

    word is set in an n-gram's row of order 1 only.
    """
    table = rows.select(*_KEY, F.posexplode_outer(words(F.col("__text"))).alias("pos", "word"))
    line = Window.partitionBy(*_KEY).orderBy("pos")
    grams = [F.col("word")]
    for k in range(1, orders):
        grams.append(F.concat(grams[-1], F.lit(" "), F.lead("word", k).over(line)))  # null past the end
    bucket = lambda g: F.pmod(F.crc32(g), F.lit(buckets)).cast("int")
    table = table.select(*_KEY, *(bucket(g).alias(f"b{k}") for k, g in enumerate(grams)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("bucket")) for k in range(orders))))
    table = table.select(*_KEY, each.alias("x")).select(*_KEY, "x.k", "x.bucket")
    return table.filter(F.col("bucket").isNotNull() | (F.col("k") == 0))


def gains(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket of ``own``, both being features; at most ``buckets`` rows."""
    count = lambda df, n: df.filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(n))
    both = cut(count(own, "s").join(count(target, "t"), "bucket", "full").na.fill(0))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    more = lambda c, by: (F.col(c) + 1).cast("double") * F.lit(float(by + buckets))
    return both.filter("s > 0").select("bucket", F.floor(1000 * F.log(more("t", total[0]) / more("s", total[1]))).alias("gain"))


def noise(id_col: Column, seed: int) -> Column:
    """A Gumbel variable times 1000, floored, from the sha256 of ``seed:<id>``; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED, size: int = BYTES, ranked: int = ROWS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``; rank is null for those that aren't drawn.

    Drawn are the highest scores, floor(percent / 100) of the rows with
    ``least`` words or more, ties to smaller ids, null ids last. Null and empty
    texts have no features and weight 0; all rows of ``target`` count, repeats
    and all. Rows that repeat an id are weighed one by one and have the same
    noise; of rows alike any comes first. An empty target leaves gains by the
    documents' own counts. Other columns are left out.
    """
    rows = keyed(docs, id_col, text_col, size)
    wanted = keyed(target.select(F.lit(0).alias("__none"), F.col(target_text).alias("__target")), "__none", "__target", size)
    table = gains(features(rows, orders, buckets), features(wanted, orders, buckets), buckets)
    weighed = features(rows, orders, buckets).join(F.broadcast(table), "bucket", "left")  # as many rows as buckets
    weighed = weighed.groupBy(*_KEY).agg(F.count(F.when(F.col("k") == 0, F.col("bucket"))).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("__sum"))
    weighed = weighed.withColumn("weight", F.expr("(__sum - pmod(__sum, greatest(n_features, 1))) div greatest(n_features, 1)"))
    weighed = cut(weighed.select(F.col("__id").alias(id_col), "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("__id"), seed)).alias("score")))
    may = weighed.filter(F.col("n_words") >= least)
    able = may.count()
    drawn = able * percent // 100
    place = running(may, [], [F.col("score").desc(), F.col(id_col).asc_nulls_last()], {"rank": F.lit(1)}, max(ranked, able // TASKS))
    place = place.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long"))
    return place.unionByName(weighed.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))).select(id_col, "n_words", "n_features", "weight", "score", "rank")


#: Remainders of the CRC of a byte, for the SQL below, which has no CRC of its own.
_CRC = """t0(i, c) AS (SELECT i, i FROM range(256) r(i)), """ + ", ".join(f"t{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END AS c FROM t{k})" for k in range(8)) + ", crc AS (SELECT list(c ORDER BY i) AS r FROM t8)"

#: DuckDB SQL of ``resample`` with its defaults, without n_words.
ORACLE = f"""WITH {_CRC},
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, len(w) AS n, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM w),
df AS (SELECT doc_id, unnest(f) AS g FROM d), bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM bw),
g AS (SELECT DISTINCT g FROM (SELECT g FROM df UNION ALL SELECT g FROM bf)),
hx AS (SELECT g, hex(encode(g)) AS h FROM g),
bytes AS (SELECT g, list_transform(range(1, len(h), 2), lambda i: ((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT) AS b FROM hx),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(r[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b FROM bytes, crc),
s AS (SELECT b, count(*) AS s FROM df JOIN b USING (g) GROUP BY 1), t AS (SELECT b, count(*) AS t FROM bf JOIN b USING (g) GROUP BY 1),
gain AS (SELECT s.b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t ON s.b = t.b),
m AS (SELECT doc_id, sum(gain)::BIGINT AS x, count(*) AS c FROM df JOIN b USING (g) JOIN gain USING (b) GROUP BY 1),
e AS (SELECT d.doc_id, d.n, len(d.f) AS n_features, coalesce((x - ((x % c) + c) % c) // c, 0)::BIGINT AS weight, list_reduce(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', sha256('7:' || d.doc_id::VARCHAR)[i]) - 1)::BIGINT), lambda p, q: p * 16 + q) AS h FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
o AS (SELECT doc_id, n, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM e),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n >= 20)
SELECT o.doc_id, n_features, weight, score, CASE WHEN p.rank <= (SELECT 25 * count(*) // 100 FROM p) THEN p.rank END AS rank FROM o LEFT JOIN p ON p.doc_id = o.doc_id"""
