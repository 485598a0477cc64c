"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash
range, the same for all texts: its size follows the text's, sketches of very
unequal texts compare without bias, and the sketch of a union is the union of
sketches. ``SCALE`` 1 keeps all and is exact. Beside the hashes a sketch has
one hash of all shingles in order, which tells apart texts so short that none
of their hashes is below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewarden.llm.common import cut, small

#: Words of a shingle; the fraction of hashes kept is 1 / SCALE.
SHINGLE, SCALE = 5, 4
SPACE = " \t\n\x0b\f\r"
LEAST = -(1 << 63)
#: A window of the order by id spans 2**SPAN ids at most; upper levels span 2**UPPER windows each. Null ids lie in 2**NULLS windows.
SPAN, UPPER, NULLS = 10, 20, 20
#: Rows of a window that one task orders; windows of more, as repeated ids make, are ordered range by range.
ROWS = 100_000


def hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """The hashes of all shingles of an array of word hashes, in order; fewer words than a shingle make one, none make none."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0)))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(shingle)))))


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` with ``out``: struct(kept array<long> ascending, whole long) of the text column (null: empty)."""
    bound = LEAST + (1 << 64) // scale
    df = df.withColumn("__t", F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)))
    df = df.withColumn("__w", F.when(F.col("__t") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("__t", "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w))))
    df = df.withColumn("__h", hashes(F.col("__w"), shingle))
    kept = F.sort_array(F.array_distinct("__h" if scale == 1 else F.filter("__h", lambda x: x < F.lit(bound))))
    return df.withColumn(out, F.struct(kept.alias("kept"), F.xxhash64("__h").alias("whole"))).drop("__t", "__w", "__h")


def shown(sketch: str) -> Column:
    """A sketch as a string: the hash of all shingles and the kept ones as hexadecimal numbers."""
    return F.concat_ws(":", F.lower(F.hex(f"{sketch}.whole")), F.array_join(F.transform(f"{sketch}.kept", lambda x: F.lower(F.hex(x))), ","))


def with_likeness(df: DataFrame, a: str, b: str, likeness: str, containment: str) -> DataFrame:
    """Adds the estimated resemblance of two sketches' shingle sets, and the larger containment of one in the other.

    Where neither has a kept hash, texts of the same shingles are alike (1) and others aren't (0).
    """
    df = df.withColumn("__n", F.size(F.array_intersect(f"{a}.kept", f"{b}.kept")))
    sizes = [F.size(f"{s}.kept") for s in (a, b)]
    neither = (F.col(f"{a}.whole") == F.col(f"{b}.whole")).cast("double")
    df = df.withColumn(likeness, F.when(F.greatest(*sizes) == 0, neither).otherwise(F.col("__n") / (sizes[0] + sizes[1] - F.col("__n"))))
    df = df.withColumn(containment, F.when(F.greatest(*sizes) == 0, neither).when(F.least(*sizes) == 0, F.lit(0.0)).otherwise(F.col("__n") / F.least(*sizes)))
    return df.drop("__n")


def next_buckets(buckets: DataFrame, bits: int = 64 - SPAN + 1) -> DataFrame:
    """(bucket, next) for distinct buckets: the next one there is, the first after the last.

    Level by level: a window spans 2**UPPER buckets, its last one takes the
    first of the next window, found in the same way. The last level has few
    rows, whatever the ids are.
    """
    if bits <= UPPER:
        line = Window.orderBy("bucket")
        first = F.first("bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return buckets.select("bucket", F.coalesce(F.lead("bucket").over(line), first).alias("next"))
    wide = buckets.withColumn("wide", F.shiftright("bucket", UPPER))
    within = wide.select("bucket", "wide", F.lead("bucket").over(Window.partitionBy("wide").orderBy("bucket")).alias("in"))
    heads = wide.groupBy("wide").agg(F.min("bucket").alias("head"))
    after = next_buckets(heads.select(F.col("wide").alias("bucket")), bits - UPPER).select(F.col("bucket").alias("wide"), F.col("next").alias("to"))
    after = after.join(heads.select(F.col("wide").alias("to"), "head"), "to").select("wide", "head")
    return within.join(after, "wide").select("bucket", F.coalesce("in", "head").alias("next"))


def with_next(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, scale: int = SCALE, rows: int = ROWS) -> DataFrame:
    """(id, text, own, next_text, next_own): each text and its sketch beside those of the next document by ascending id, the first one's after the last.

    Rows that share an id are ordered by text; null ids come first, in the
    order of a hash of their texts; null texts become empty. Which window of
    ids follows which is found on window numbers alone; texts are shuffled
    once, and each window's first row is fetched by the one before. A window
    of over ``rows`` rows is cut into ranges by id and text, of which the first
    row of the next is fetched alike.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    null_bucket = F.lit((LEAST >> SPAN) - (1 << NULLS)) + F.pmod(F.xxhash64("text"), F.lit(1 << NULLS))
    docs = docs.withColumn("bucket", F.coalesce(F.shiftright("id", SPAN), null_bucket))
    heads = cut(docs.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")))
    at = heads.select(F.col("bucket").alias("b"), "head")
    firsts = docs.join(small(at), (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("head")))
    firsts = with_sketch(firsts.groupBy("bucket").agg(F.min("text").alias("text")), "text", "own", shingle, scale)
    firsts = firsts.select("bucket", F.struct("text", "own").alias("first"))
    after = cut(next_buckets(heads.select("bucket"))).withColumnRenamed("bucket", "b").join(firsts, F.col("next") == F.col("bucket"))
    after = cut(after.select(F.col("b").alias("bucket"), "first"))
    row, large = F.struct("text", "own"), heads.filter(F.col("n") > rows)
    many = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = docs.join(small(large.select("bucket")), "bucket", "left_anti") if many else docs
    few = with_sketch(few.repartition("bucket"), "text", "own", shingle, scale)
    few = few.withColumn("in", F.lead(row).over(Window.partitionBy("bucket").orderBy("id", "text")))
    if many:
        dealt = docs.join(small(large.select("bucket")), "bucket", "left_semi").repartitionByRange(-(-many // rows) + 1, "bucket", "id", "text")
        dealt = cut(with_sketch(dealt.withColumn("range", F.spark_partition_id()), "text", "own", shingle, scale))
        starts = dealt.groupBy("bucket", "range").agg(F.min(F.struct("id", "text", "own")).alias("start"))
        starts = cut(starts.withColumn("start", F.lead("start").over(Window.partitionBy("bucket").orderBy("range"))))  # a row for each range
        line = Window.partitionBy("bucket", "range").orderBy("id", "text")
        rest = dealt.withColumn("in", F.lead(row).over(line)).join(starts, ["bucket", "range"])
        following = F.when(F.col("start").isNotNull(), F.struct("start.text", "start.own"))
        few = few.unionByName(rest.withColumn("in", F.coalesce("in", following)).select(*few.columns))
    df = few.join(after, "bucket").withColumn("then", F.coalesce("in", "first"))
    return df.select(F.col("id").alias(id_col), "text", "own", F.col("then.text").alias("next_text"), F.col("then.own").alias("next_own"))


def half_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every whole text and of its edit, and their likenesses.

    The edit replaces the last floor(n_chars / 2) code points by the first as
    many (or all) of the next document by ascending id. (id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited, contained_next), a row for every row; a lone document is
    its own next one, an empty table gives no rows, other columns are ignored.
    """
    df = with_next(docs, id_col, text_col, shingle, scale)
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    df = with_sketch(df.drop("text", "next_text"), "edited", "made", shingle, scale)
    df = df.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    df = with_likeness(df, "own", "made", "near_edited", "contained_edited")
    df = with_likeness(df, "own", "next_own", "near_next", "contained_next")
    return df.select(id_col, "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("made").alias("edited_fingerprint"), "near_edited", "near_next", "contained_edited", "contained_next")
