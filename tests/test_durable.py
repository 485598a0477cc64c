"""Running sums, in one task and range by range."""

from pyspark.sql import functions as F

from namewarden.operators.durable import running


def test_running_sums_range_by_range(spark):
    rows = [(g, (i * 7919) % 1000, i % 5) for i in range(1000) for g in ((None, "a")[i % 2], "hot")]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    want = {}
    for g in (None, "a", "hot"):
        total = 0
        for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            want[g, k], total = total, total + v
    for few in (10, 10_000):
        got = {(r.g, r.k): r.s for r in running(df, ["g"], [F.col("k")], {"s": F.col("v")}, few).collect()}
        assert got == want
        all_rows = running(df, [], [F.col("k"), F.col("g")], {"n": F.lit(1)}, few)
        assert sorted(r.n for r in all_rows.collect()) == list(range(2000))
