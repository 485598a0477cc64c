"""Evaluation: confusion counts and what follows from them, sweeps, curves, tallies and joins with the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewarden.operators.durable import running


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), overall: bool = False) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, accuracy of two boolean columns; by groups, and ``overall`` too (groups null)."""
    t, p = F.col(truth), F.col(predicted)
    counts = [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn")]
    if by and overall:
        out = df.groupingSets([list(map(F.col, by)), []], *map(F.col, by)).agg(*counts)
    else:
        out = df.groupBy(*by).agg(*counts)
    return with_ratios(out)


def with_ratios(counts: DataFrame) -> DataFrame:
    """Counts with precision, recall, f1, accuracy, specificity, fpr and fnr; 0 where a denominator is."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    df = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn), "specificity": ratio(tn, tn + fp), "fpr": ratio(fp, tn + fp), "fnr": ratio(fn, tp + fn)})
    return df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def steps(df: DataFrame, low: int, high: int, step: int, by: float, name: str) -> DataFrame:
    """``df`` with every threshold low * by, (low + step) * by, ..., high * by beside each row."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step)))).withColumn(name, F.col(name) * by)


def sweep(df: DataFrame, truth: str, score: str, low: int = 0, high: int = 100, step: int = 1, by: float = 0.01) -> DataFrame:
    """Confusion for every threshold that a score is at or over.

    Scores are first counted by the thresholds that they pass, so the rows
    aren't multiplied; only the counts are.
    """
    level = F.least(F.floor(F.col(score) / by + 1e-9), F.lit(high)).cast("int")
    few = df.withColumn("__level", level).groupBy("__level", F.col(truth).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    return _swept(few, low, high, step, by)


def sweep_counts(counts: DataFrame, level: str, low: int = 0, high: int = 100, step: int = 1, by: float = 0.01) -> DataFrame:
    """``sweep`` of rows already counted: p true and n false ones at each level, a score / by rounded down."""
    pair = F.array(*(F.struct(F.lit(t).alias("t"), F.col(c).alias("n")) for t, c in ((True, "p"), (False, "n"))))
    few = counts.select(F.least(F.col(level), F.lit(high)).alias("__level"), F.explode(pair).alias("x"))
    return _swept(few.select("__level", F.col("x.t").alias("__t"), F.col("x.n").alias("__n")), low, high, step, by)


def _swept(few: DataFrame, low: int, high: int, step: int, by: float) -> DataFrame:
    few = few.withColumn("__k", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))))
    t, p, n = F.col("__t"), F.col("__level") >= F.col("__k"), F.col("__n")
    count = lambda c, name: F.sum(F.when(c, n).otherwise(0)).alias(name)
    out = few.groupBy("__k").agg(count(t & p, "tp"), count(~t & p, "fp"), count(~t & ~p, "tn"), count(t & ~p, "fn"))
    return with_ratios(out).withColumn("threshold", F.round(F.col("__k") * by, 6)).drop("__k")


def balanced(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of either class as the smaller one has, the first by md5 of ``seed:key``; null labels are in neither.

    Keys tell rows apart; ranks come from running counts, range by range.
    """
    rows = df.filter(F.col(label).isNotNull())
    few = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.count(F.lit(1))).first()
    if few[1] < 2:
        return rows.limit(0)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    ranked = running(rows.withColumn("__order", order), [label], [F.col("__order"), F.col(key)], {"__place": F.lit(1)})
    return ranked.filter(F.col("__place") < few[0]).drop("__order", "__place")


def best_by(df: DataFrame, value: str, *order: str) -> DataFrame:
    """The row of the greatest value; of equals the first in order."""
    return df.orderBy(F.col(value).desc(), *order).limit(1)


def roc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, tpr, fpr) at every distinct score, highest first."""
    at = df.groupBy(score).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    at = running(at, [], [F.col(score).desc()], {"__p": F.col("p"), "__n": F.col("n")})
    whole = at.agg(F.sum("p").alias("__all_p"), F.sum("n").alias("__all_n"))  # one row
    share = lambda c: F.try_divide(F.col(f"__{c}") + F.col(c), F.col(f"__all_{c}"))
    return at.join(F.broadcast(whole)).select(score, share("p").alias("tpr"), share("n").alias("fpr"), "p", "n")


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: the area under the curve, from the counts at each distinct score (ties count half)."""
    at = df.groupBy(score).agg(F.count_if(F.col(truth)).cast("double").alias("p"), F.count_if(~F.col(truth)).cast("double").alias("n"))
    return auc_counts(at, score)


def auc_counts(at: DataFrame, score: str) -> DataFrame:
    """``auc`` of rows already counted: p true and n false ones at each distinct score."""
    at = at.select(score, F.col("p").cast("double").alias("p"), F.col("n").cast("double").alias("n"))
    at = running(at, [], [F.col(score)], {"below": F.col("n")})
    at = at.withColumn("won", F.col("p") * (F.col("below") + F.col("n") / 2))
    return at.agg(ratio(F.sum("won"), F.sum("p") * F.sum("n")).alias("auc"))


def latency(df: DataFrame, seconds: str) -> DataFrame:
    """mean_ms, median_ms, packages, total_s and throughput per second."""
    s = F.col(seconds)
    return df.agg((F.avg(s) * 1000).alias("mean_ms"), (F.median(s) * 1000).alias("median_ms"), F.count(s).alias("packages"), F.sum(s).alias("total_s"), ratio(F.count(s), F.sum(s)).alias("throughput"))


def category_counts(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """(category, n) of comma-separated categories."""
    parts = df.select(F.explode(F.split(column, separator)).alias("category")).withColumn("category", F.trim("category"))
    return parts.filter("category <> ''").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def label_tally(df: DataFrame, column: str) -> DataFrame:
    """Rows that say yes, no, something unknown or nothing, and the share of yes among the known."""
    low = F.lower(F.trim(column))
    yes, no = F.count_if(low == "yes"), F.count_if(low == "no")
    return df.agg(yes.alias("yes"), no.alias("no"), F.count_if(F.coalesce(low, F.lit("")) == "").alias("missing"), F.count_if(low.contains("unk")).alias("unknown"), ratio(yes * 100, yes + no).alias("yes_percent"))


def known_label(column: Column) -> Column:
    """True for yes, false for no, null for what is unknown or missing."""
    low = F.lower(F.trim(column))
    return F.when(low == "yes", True).when(low == "no", False)


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(flag, n) of true values, most first."""
    counts = df.agg(*(F.count_if(F.col(c)).alias(c) for c in flags))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("flag"), F.col(c).alias("n")) for c in flags))).alias("x")
    return counts.select(pairs).select("x.flag", "x.n").orderBy(F.col("n").desc(), "flag")


def match_rates(df: DataFrame, categories: str, of: dict[str, tuple[str, bool]]) -> DataFrame:
    """(category, n, rate): how often a category's flag, or for inverse ones its opposite, is set in rows that name it."""
    rows = df.withColumn("category", F.explode(F.split(categories, ","))).withColumn("category", F.trim("category"))
    hit = None
    for name, (flag, inverse) in of.items():
        value = ~F.col(flag) if inverse else F.col(flag)
        hit = F.when(F.col("category") == name, value) if hit is None else hit.when(F.col("category") == name, value)
    return rows.withColumn("hit", hit).filter(F.col("hit").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("rate"))


def last_by_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each trimmed lower-case key."""
    order = Window.partitionBy("__key").orderBy(F.col(position).desc())
    return df.withColumn("__key", F.lower(F.trim(key))).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def truth_and_output(truth: DataFrame, output: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of both whose keys match, the last of each on either side."""
    left, right = last_by_key(truth, key, position), last_by_key(output, key, position)
    return left.drop(position).join(right.drop(key, position), "__key").withColumnRenamed("__key", "match_key")


def flagged(df: DataFrame, key: str, is_fp: str) -> DataFrame:
    """(key, flagged): any of a package's rows isn't a false positive."""
    return df.groupBy(key).agg(F.bool_or(~F.col(is_fp)).alias("flagged"))


def threat_category(threat: Column) -> Column:
    return F.when(threat == "false_positive", "benign").when(threat == "typosquat", "stealthy").otherwise("active")


def label_category(label: Column) -> Column:
    known = known_label(label)
    return F.when(known, "benign").when(~known, "stealthy")


def detection_status(missing: Column, results: Column) -> Column:
    return F.when(missing, "TP (Missing Metadata)").when(F.size(results) > 0, "TP").otherwise("FP")


def package_verdict(df: DataFrame, package: str, place: str, is_fp: str, most: int = 3) -> DataFrame:
    """(package, detected, neighbours): a package is detected if any of its first neighbours is; the second one isn't looked at after a hit."""
    hit = ~F.col(is_fp)
    first = F.max(F.when(F.col(place) == 1, hit)).over(Window.partitionBy(package))
    looked = (F.col(place) <= most) & ~((F.col(place) == 2) & F.coalesce(first, F.lit(False)))
    return df.withColumn("__look", looked).filter("__look").groupBy(package).agg(F.bool_or(hit).alias("detected"), F.count(F.lit(1)).alias("neighbours"))


def with_truth(results: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results with the truth's columns; those that it doesn't know keep nulls."""
    return results.join(truth, list(keys), "left")


def truth_key(kind: Column, name: Column, space: Column) -> Column:
    """type:name, and :namespace if there is one."""
    return F.concat_ws(":", kind, name, F.nullif(space, F.lit("")))


def with_category(groups: DataFrame, truth: DataFrame, key: str, category: str, text: str) -> DataFrame:
    """Groups with the truth's category; unmatched ones take it from a text that names one, else benign."""
    low = F.lower(F.coalesce(text, F.lit("")))
    told = F.when(low.contains("stealthy"), "stealthy").when(low.contains("active"), "active").otherwise("benign")
    return groups.join(truth.select(key, category), key, "left").withColumn(category, F.coalesce(category, told))


def edit_classifier(df: DataFrame, truth: str, edits: str, limits: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """Confusion of taking pairs within each number of edits for positive, and mean_f1 of both classes."""
    rows = df.withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    out = confusion(rows.withColumn("__hit", F.col(edits) <= F.col("limit")), truth, "__hit", ["limit"])
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return out.withColumn("negative_f1", ratio(2 * tn, 2 * tn + fp + fn)).withColumn("mean_f1", (F.col("f1") + F.col("negative_f1")) / 2)
