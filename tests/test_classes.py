"""Copies as classes: the same losers and pairs as entry by entry, in rows that grow with the copies and not with their square."""

import random

from palimpsest.operators import audit, similarity
from pyspark.sql import functions as F


def entries(spark, seed):
    r = random.Random(seed)
    topics = [" ".join(r.choice(["walnut", "granite", "copper", "lantern", "harbor", "meadow", "timber", "saddle"]) + str(r.randrange(4)) for _ in range(8)) for _ in range(8)]
    texts = [("↪ " if r.random() < 0.3 else "") + (t if r.random() < 0.6 else t + r.choice([" fixed 2024-01-02", " always", " extra9"])) for t in (r.choice(topics) for _ in range(90))]
    return spark.createDataFrame([(i, "memory" if i % 2 else "user", t) for i, t in enumerate(texts)], "ref long, store string, text string")


def test_losers_are_those_of_the_pairs(spark):
    for seed in (1, 2):
        a = audit.audit(entries(spark, seed), F.to_date(F.lit("2024-06-01"))).cache()
        want = {r.loser for r in audit.duplicates(a, 0.45).collect()}
        got = [r.ref for r in audit.losers(a, 0.45).collect()]
        assert set(got) == want and len(got) == len(want) > 20


def test_many_copies_make_few_rows(spark):
    same = spark.range(2000).select("id", F.array(*[F.lit(f"t{i}") for i in range(10)]).alias("tokens"))
    near = spark.range(2000, 2500).select("id", F.array(*[F.lit(f"t{i}") for i in range(9, -2, -1)]).alias("tokens"))
    members, pairs = similarity.similar_classes(same.union(near).union(spark.range(9000, 9003).select("id", F.array().cast("array<string>"))), 0.5)
    assert members.count() == 2500 and {r.rep for r in members.select("rep").distinct().collect()} == {0, 2000}
    assert [tuple(r) for r in pairs.select("a", "b", "common", "either").collect()] == [(0, 2000, 10, 11)]
    assert similarity.similar_classes(same.limit(0), 0.5)[0].count() == 0
