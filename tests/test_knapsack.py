"""Groups of a knapsack follow each other in a task and may be cut by batches."""

import random
from itertools import combinations

from palimpsest.operators import projection
from pyspark.sql import functions as F


def test_groups_over_batches(spark):
    r = random.Random(4)
    rows = [(g, i, g * 10 + i, r.randint(1, 9), r.randint(0, 99) / 100, 12 if g % 3 else 90) for g in range(20) for i in range(r.randint(1, 8))]
    items = spark.createDataFrame(rows, "grp long, ord long, ref long, tokens int, score double, room int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = projection.knapsack(items)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(20):
        own = [x for x in rows if x[0] == g]
        best = max(sum(x[4] for x in c) for k in range(len(own) + 1) for c in combinations(own, k) if sum(x[3] for x in c) <= own[0][5])
        mine = [x for x in got if x.grp == g]
        assert abs(sum(x.score for x in mine) - best) < 1e-9 and sum(x.tokens for x in mine) <= own[0][5]
    assert len({x.ref for x in got}) == len(got)


def test_groups_stay_whole_as_joins_change(spark):
    """Of a larger table the sums that are joined to its items are small enough to be sent to all tasks, and the items lie by weight."""
    items = spark.range(40_000).select(F.floor(F.col("id") / 8).alias("grp"), F.col("id").alias("ord"), F.col("id").alias("ref"), (F.col("id") % 8 + 300).cast("int").alias("tokens"), F.lit(0.5).alias("score"), F.lit(1000).alias("room"))
    held = {"spark.sql.autoBroadcastJoinThreshold": str(200 << 10), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        taken = projection.knapsack(items).groupBy("grp").agg(F.sum("tokens").alias("tokens")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(taken) == 5000 and max(x.tokens for x in taken) <= 1000
