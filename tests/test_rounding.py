"""Rounding that the queries' SQL does in double precision."""

from palimpsest.functions.text import rounded
from palimpsest.operators.audit import losers
from palimpsest.operators.retrieval import ranked_relevance
from palimpsest.plans.recall_queries import _hundredths
from pyspark.sql import functions as F


def test_hundredths_equal_sql(spark, duck):
    want = duck.execute("SELECT round(x, 2) FROM (SELECT i, round(i / 10000e0, 4) AS x FROM range(10001) t(i)) ORDER BY i").fetchall()
    got = spark.range(10001).select("id", _hundredths(F.round(F.col("id") / 10000, 4)).alias("x")).orderBy("id").collect()
    assert [r.x for r in got] == [x for x, in want]


def test_four_places_equal_sql(spark, duck):
    """Also just beside a half, as sums of weighted scores are."""
    beside = "0.21944999999999998e0, 0.19945e0, 0.28500000000000003e0"
    want = duck.execute(f"SELECT round(x, 4) FROM (SELECT unnest([{beside}]) AS x UNION ALL SELECT i / 100000e0 FROM range(100001) t(i)) ORDER BY x").fetchall()
    rows = spark.sql(f"SELECT explode(array({beside})) AS x").union(spark.range(100001).select(F.col("id") / 100000))
    got = rows.select("x", rounded(F.col("x"), 4).alias("r")).orderBy("x").collect()
    assert [r.r for r in got] == [x for x, in want]


def test_relevance_ranks_and_losers_by_sql_rounding(spark):
    hits = spark.createDataFrame([(1, 1, 0.21944999999999998), (1, 2, 0.2195)], "query_id long, id long, score double")
    hashes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, hash string")
    assert [r.id for r in ranked_relevance(hits, hashes).orderBy("rank").collect()] == [1, 2]
    audited = spark.createDataFrame([(1, "note", (0.285,), ["x", "y"]), (2, "note", (0.284,), ["x", "y"])], "ref long, kind string, scores struct<overall: double>, bag array<string>")
    assert [r.ref for r in losers(audited, 0.45).collect()] == [1]
