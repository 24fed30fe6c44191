"""Vector search by blocked products against brute force, with vectors that have no plain score."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import retrieval as R


def test_top_k_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, [1.0, 1.0, 0.0, 2.0]) for i in range(60)]
    rows += [(500, [0.0] * 4), (501, None), (502, [1.0, None, 0.0, 1.0]), (503, [float("nan"), 1.0, 0.0, 0.0]), (504, [1.0, 2.0]), (505, [1e-200, 0.0, 0.0, 0.0]), (506, [float("inf"), 0.0, 0.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    q = v.where("id % 20 = 0 or id > 499").withColumnRenamed("id", "query_id")

    # every pair, scored by Spark's own expressions
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    norm = lambda a: F.sqrt(dot(a, a))
    pairs = v.crossJoin(q.withColumnRenamed("vector", "asked")).where("size(vector) = size(asked)").withColumns({"n": norm("vector"), "m": norm("asked")})
    pairs = pairs.withColumn("score", F.when((F.col("n") == 0) | (F.col("m") == 0), 0.0).otherwise(dot("vector", "asked") / (F.nullif("n", F.lit(0.0)) * F.nullif("m", F.lit(0.0)))))
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 5")
    plain = lambda frame: sorted((r.query_id, r.id, r["rank"], repr(r.score)) for r in frame.collect())
    expected = plain(best)
    for sizes in ({}, {"strip": 2000, "sent": 300}):
        assert plain(R.vector_topk(v, q, 5, **sizes)) == expected


def test_pairs_are_not_made_by_a_join(spark):
    v = spark.range(40).selectExpr("id", "array(cast(id as double), 1d) as vector")
    plan = R.vector_topk(v, v.withColumnRenamed("id", "query_id"), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
