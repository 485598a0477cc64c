"""Tables written to the checkpoint folder, and running sums that no single task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Has Spark remove a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a checkpointed table of few columns that may be broadcast, or ordered in one task; more are shuffled, or ordered range by range.
FEW = 1_000_000


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where ``spark.checkpoint.dir`` says; without it a local session uses a folder of its own and a cluster raises.

    A machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or "spark-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: its lineage is cut, its shuffles are removed and executors may be lost."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query made while it is set
    finally:
        spark.conf.set(CLEANUP, before)


def small(df: DataFrame, few: int = FEW) -> DataFrame:
    """A checkpointed table of few columns, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= few else df


#: Keys that over 1 / HOT of all rows have, so fewer than HOT, are hot.
HOT = 1000


def join_split(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` beside the row of ``table`` with the same key, inner or left; ``table`` has one for each key.

    A hot key's rows aren't shuffled to one task: the rows of the fewer than
    ``HOT`` hot keys are joined by broadcast, the others by a shuffle.
    """
    counts = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.filter(F.col("__n") * HOT > total).select(key).filter(F.col(key).isNotNull()))
    made = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, how)
    return made.unionByName(rows.join(hot, key, "left_anti").join(table, key, how))


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], few: int = FEW) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum over the rows of the group that come before by ``order`` (0 at first).

    ``order`` tells all rows of a group apart, or rows alike get their sums in
    any order. Over ``few`` rows are ordered range by range: sums of ranges are
    added up and given to each range's rows, so no task holds a large group.
    """
    before = lambda by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = cut(df.withColumns({f"__of_{c}": x for c, x in sums.items()}))
    n, columns = df.count(), ["`" + c.replace("`", "``") + "`" for c in df.columns if not c.startswith("__of_")]
    if n <= few:
        line = before(group or [F.lit(0)])
        return df.select(*columns, *(F.coalesce(F.sum(f"__of_{c}").over(line), F.lit(0)).alias(c) for c in sums))
    df = cut(df.repartitionByRange(-(-n // few) + 1, *group, *order).withColumn("__range", F.spark_partition_id()))
    totals = df.groupBy("__range", *group).agg(*(F.sum(f"__of_{c}").alias(f"__sum_{c}") for c in sums))
    line = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__range").alias("__at"), *(F.col(g).alias(f"__by_{g}") for g in group), *(F.coalesce(F.sum(f"__sum_{c}").over(line), F.lit(0)).alias(f"__from_{c}") for c in sums))
    same = F.col("__range") == F.col("__at")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__by_{g}"))
    df = df.join(small(cut(starts)), same)
    line = before(["__range", *group])
    return df.select(*columns, *((F.coalesce(F.sum(f"__of_{c}").over(line), F.lit(0)) + F.col(f"__from_{c}")).alias(c) for c in sums))
