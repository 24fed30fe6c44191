"""A rewrite plan is made from what is kept of a text; the text itself is neither stored nor shuffled, and with it the plan is the same."""

from pyspark.sql import functions as F

from palimpsest.constants import DUP_NEAR
from palimpsest.functions import shared
from palimpsest.operators import audit, rewrite
from palimpsest.plans import report_queries
from palimpsest.plans.bind import TODAY, entries

from .conftest import SF


def test_plan_without_texts(spark, monkeypatch):
    kept = []

    def stored(df, label, *more):
        kept.append((label, df.columns))
        return shared.stored(df, label, *more)

    for module in (audit, rewrite, report_queries):
        monkeypatch.setattr(module, "stored", stored)
    got = {tuple(r) for r in report_queries.rewrite_decisions(spark, SF).collect()}
    assert kept and not [label for label, columns in kept if "text" in columns]
    whole = shared.stored(audit.audit(entries(spark, SF), F.lit(TODAY).cast("date")), "whole")
    c = audit.contradictions(whole)
    told = audit.recommend(whole, audit.losers(whole, DUP_NEAR), c.select(F.col("a").alias("ref")).union(c.select("b")))
    want = rewrite.decide(told, TODAY)
    assert got == {tuple(r) for r in want.select("ref", "action", "rewrite", "char_delta").collect()}
    again = report_queries._rewritten(spark, SF).select("ref", "new_text").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in want.select("ref", "new_text").collect()}
