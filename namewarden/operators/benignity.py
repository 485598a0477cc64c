"""Benignity rules: facts from metadata, the judge's flags, and the risk score."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewarden.config import RISK, RISK_LOW, RISK_MEDIUM, RISK_MOST

#: What a judge says of a pair of packages.
JUDGED = ("obvious_not_typosquat", "is_adversarial_name", "has_distinct_purpose", "is_fork", "is_known_maintainer", "has_suspicious_intent", "no_readme", "is_relocated_package", "is_test")


def overlapping(suspect: Column, target: Column) -> Column:
    """Whether enough maintainers are shared: one; of over three (repeats counted) two or more than half."""
    shared = F.size(F.array_intersect(suspect, target))
    count = F.size(target)
    enough = F.when(count > 3, (shared >= 2) | (shared / count > 0.5)).otherwise(shared >= 1)
    return F.coalesce((F.size(suspect) > 0) & (count > 0) & enough, F.lit(False))


def comprehensive(license_: Column, people: Column, repository: Column, webpage: Column, has_description: Column, has_readme: Column) -> Column:
    """Three of license, maintainers, repository and page, and the fields description and readme."""
    filled = sum((F.coalesce(F.length(c) > 0, F.lit(False)).cast("int") for c in (license_, repository, webpage)), F.coalesce(F.size(people) > 0, F.lit(False)).cast("int"))
    return (filled >= 3) & has_description & has_readme


def active(pushed_at: Column, versions: Column, as_of: Column) -> Column:
    """Pushed within 365 whole days of ``as_of`` and over five versions (1 if unknown)."""
    pushed = F.try_to_timestamp(pushed_at, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")) if not isinstance(pushed_at, str) else F.col(pushed_at)
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(pushed)) / 86400)
    return F.coalesce((days <= 365) & (F.coalesce(versions, F.lit(1)) > 5), F.lit(False))


def risk_score(adversarial: Column, suspicious: Column, no_readme: Column, comprehensive: Column, active: Column, obvious: Column, fork: Column, test: Column, distinct: Column, known: Column, overlap: Column, relocated: Column) -> Column:
    """Points of the flags, 0 to 10. A missing readme counts once: it takes the place of a suspicion that it may have caused."""
    on = lambda flag, name: F.when(flag, RISK[name]).otherwise(0)
    points = on(adversarial, "adversarial") + F.when(suspicious & ~no_readme, RISK["suspicious"]).when(no_readme, RISK["no_readme"]).otherwise(0)
    points = points + on(~comprehensive, "bare_metadata") + on(active, "active") + on(obvious, "obvious") + on(fork, "fork") + on(test, "test")
    points = points + on(distinct, "distinct") + on(known & ~suspicious, "known") + on(overlap, "overlap") + on(relocated, "relocated")
    return F.greatest(F.lit(0), F.least(F.lit(RISK_MOST), points))


def risk_level(score: Column) -> Column:
    return F.when(score < RISK_LOW, "Low").when(score < RISK_MEDIUM, "Medium").otherwise("High")


def is_benign(score: Column) -> Column:
    return score < RISK_LOW


def command_verdict(confidence: Column, verdict: Column) -> Column:
    """A judge's verdict on a command squat if it is sure, else benign."""
    return F.when(confidence > 0.8, verdict).otherwise(True)


def no_judge(pairs: pd.DataFrame) -> pd.DataFrame:
    """A judge that says nothing; every flag is false."""
    return pd.DataFrame({k: [False] * len(pairs) for k in JUDGED}).assign(explanation="", error=None)


def judged(pairs: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame] = no_judge) -> DataFrame:
    """Pairs with a judge's flags, explanation and error.

    ``judge`` takes and returns pandas frames of a batch. What it raises leaves
    the flags of the batch false and is told in error, so that an outage isn't
    taken for a verdict.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema] + [f"{k} boolean" for k in JUDGED] + ["explanation string", "error string"])

    def run(frames):
        for f in frames:
            try:
                said = judge(f)
            except Exception as e:  # noqa: BLE001 a judge may raise anything
                said = no_judge(f).assign(error=f"{type(e).__name__}: {e}")
            yield pd.concat([f.reset_index(drop=True), said.reset_index(drop=True)], axis=1)

    return pairs.mapInPandas(run, schema)


def verified(df: DataFrame) -> DataFrame:
    """Judged pairs with active, comprehensive and overlap flags: score, level, is_false_positive and category.

    A pair whose judge failed is undecided: is_false_positive is null.
    """
    c = F.col
    score = risk_score(c("is_adversarial_name"), c("has_suspicious_intent"), c("no_readme"), c("comprehensive_metadata"), c("active_development"), c("obvious_not_typosquat"), c("is_fork"), c("is_test"), c("has_distinct_purpose"), c("is_known_maintainer"), c("overlapped_maintainers"), c("is_relocated_package"))
    df = df.withColumn("risk_score", score).withColumn("risk_level", risk_level(c("risk_score")))
    df = df.withColumn("is_false_positive", F.when(c("error").isNull(), is_benign(c("risk_score"))))
    return df.withColumns({"FP_category": F.concat(F.lit("risk_level: "), c("risk_level")), "explanation": F.concat(c("explanation"), F.lit(" Risk level: "), c("risk_level"), F.lit(")."))})
