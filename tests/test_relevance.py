"""Relevance is summed from what queries ask for, only what can be among the best is ranked by hash, and scores carry no texts."""

import math
import random

from palimpsest.operators import retrieval
from palimpsest.plans import recall_queries

from .conftest import SF


def test_best_of_the_relevant(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(retrieval, "stored", lambda df, label, *more, real=retrieval.stored: kept.setdefault(label, real(df, label, *more)))
    r = random.Random(2)
    entries = {i: sorted({f"w{min(r.randrange(12), r.randrange(12))}" for _ in range(r.randint(0, 6))}) for i in range(60)}
    queries = {1: ["w1", "w2", "none"], 2: ["w0"], 3: []}
    docs, asked = spark.createDataFrame(list(entries.items()), "id long, tokens array<string>"), spark.createDataFrame(list(queries.items()), "query_id long, tokens array<string>")
    hits = retrieval.lexical_relevance(docs, asked)
    assert {x.token for x in kept["asked-words"].select("token").distinct().collect()} <= {"w0", "w1", "w2"}
    weight = lambda t: math.log1p(len(entries) / n) if (n := sum(t in e for e in entries.values())) else math.log1p(len(entries))
    want = {(q, i): sum(weight(t) for t in ts if t in e) / sum(map(weight, ts)) for q, ts in queries.items() for i, e in entries.items() if set(ts) & set(e)}
    got = {(x.query_id, x.id): x.score for x in hits.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    hashes = spark.createDataFrame([(i, f"h{i * 7 % 5}") for i in entries], "id long, hash string")
    whole = {(x.query_id, x.id, x.rank) for x in retrieval.ranked_relevance(hits, hashes).where("rank <= 5").collect()}
    assert whole == {(x.query_id, x.id, x.rank) for x in retrieval.ranked_relevance(hits, hashes, 5).collect()}


def test_scores_carry_no_text(spark):
    assert "text" not in recall_queries._scored(spark, SF).columns
