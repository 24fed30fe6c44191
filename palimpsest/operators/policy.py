"""Retention policies as rows: what is wrong with them, what they warn of, and whether they do anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What deletes or rewrites, and what must be true or false.
DESTRUCTIVE = ("prune_closed", "prune_unclosed", "delete_compression_parents", "drop_trigram", "vacuum")
FLAGS = (*DESTRUCTIVE, "include_dormant_profiles", "include_snapshots")


def judged(policies: DataFrame, schema: str) -> DataFrame:
    """policies (schema, retention_days, protect_recent_days, and the flags, null where missing or no boolean) with errors, warnings and noop; schema is the format's name that they must carry.

    A policy that prunes needs a positive retention; less than a week of it is a warning."""
    on = lambda c: F.coalesce(c, F.lit(False))
    prunes = on("prune_closed") | on("prune_unclosed")
    errors = {
        "schema": ~F.col("schema").eqNullSafe(F.lit(schema)), "retention_missing": prunes & F.col("retention_days").isNull(), "retention_not_positive": prunes & (F.col("retention_days") < 1),
        **{f"{c}_not_boolean": F.col(c).isNull() for c in FLAGS}, "protect_recent_negative": F.col("protect_recent_days") < 0,
    }
    other = F.lit(False)
    for c in DESTRUCTIVE:
        if c != "vacuum":
            other = other | on(c)
    warnings = {
        "aggressive_retention": prunes & (F.col("retention_days") < 7), "prunes_unclosed": on("prune_unclosed"), "drops_originals": on("delete_compression_parents"), "drops_trigram": on("drop_trigram"),
        "targets_snapshots": on("include_snapshots"), "no_vacuum": ~on("vacuum") & other,
    }
    said = lambda tests: F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))
    return policies.withColumn("errors", said(errors)).withColumn("warnings", said(warnings)).withColumn("noop", ~(other | on("vacuum")))
