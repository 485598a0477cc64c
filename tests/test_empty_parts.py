"""Few rows over many partitions, most of them empty."""

import numpy as np
from pyspark.sql import functions as F

from namewarden.operators import angles, pairwise, subwords, vector_index, vectors


def test_operators_over_empty_partitions(spark, tmp_path):
    names = spark.createDataFrame([("a-b",), ("b-c",), ("cab",)], "package_name string").repartition(20)
    units = subwords.train(names, dim=2, columns=8)
    assert units.count() == 21 and subwords.name_vectors(names, units, 2).count() == 3
    rows = spark.createDataFrame([(i, [float(i), 1.0, 2.0], i % 2) for i in range(5)], "vec_id long, embedding array<double>, label int").repartition(20)
    assert vectors.projected(rows, "vec_id", "embedding").count() == 5
    side = lambda c: rows.select(F.col("vec_id").alias(c), F.col("embedding").alias("v"))
    assert angles.cosine_over(side("a"), side("b"), 0.9, cell=2, rows=2).count() == 15
    assert vector_index.build(rows, str(tmp_path / "i"), "vec_id", "embedding")["rows"] == 5
    index = vector_index.Index(spark, str(tmp_path / "i"))
    assert index.search(rows, "vec_id", "embedding", 2).count() == 10
    assert pairwise.pairs(rows).count() == 10 and pairwise.counted(rows, lambda s: np.floor(s * 10), -11, 11).agg(F.sum(F.col("p") + F.col("n"))).first()[0] == 10
