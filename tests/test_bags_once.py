"""What a join reads twice is made once, and declared defaults are looked for where the word is."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import declared_defaults
from palimpsest.operators import audit as A


def entries(spark):
    e = spark.createDataFrame([(1, "memory", "Postgres keeps every message of the queue."), (2, "user", "postgres keeps every message of the queue")], "ref long, store string, text string")
    return A.audit(e, F.lit("2024-06-01").cast("date"))


@pytest.mark.parametrize("use, join", [(A.duplicates, "similar_pairs"), (A.losers, "similar_classes")])
def test_bags_are_stored_before_the_join(spark, monkeypatch, use, join):
    given, real = [], getattr(A, join)
    monkeypatch.setattr(A, join, lambda sets, near: given.append(sets) or real(sets, near))
    assert use(entries(spark), 0.45).count() == 1
    assert "regexp" not in given[0]._jdf.queryExecution().optimizedPlan().toString()


def test_defaults_are_looked_for_where_the_word_is(spark):
    df = spark.createDataFrame([("Postgres is the default",), ("sqlite as Default",), ("switched to vim",), ("the DEFAULT: move to emacs",), (None,)], "t string").select(declared_defaults(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == [["postgres"], ["sqlite"], [], ["emacs"], None]
    assert "Contains(" in df._jdf.queryExecution().analyzed().toString().split("concat(")[0]
