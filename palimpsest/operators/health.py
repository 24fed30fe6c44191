"""Capacity and health flags, and roll-ups where the worst wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CAPACITY_CRIT, CAPACITY_WARN, DB_CRIT_MB, DB_WARN_MB, ENTRY_CEILING, ENTRY_TARGET

#: How bad a status is; a check that couldn't run ranks with a warning.
RANKS = {"ok": 0, "green": 0, "unknown": 1, "yellow": 1, "warning": 1, "red": 2, "critical": 2, "error": 2}


def capacity_flag(percent: Column) -> Column:
    return F.when(percent >= CAPACITY_CRIT, "critical").when(percent >= CAPACITY_WARN, "warning").otherwise("ok")


def entry_pressure(count: Column) -> Column:
    return F.when(count > ENTRY_CEILING, "critical").when(count > ENTRY_TARGET, "warning").otherwise("ok")


def size_flag(mb: Column) -> Column:
    return F.when(mb >= DB_CRIT_MB, "critical").when(mb >= DB_WARN_MB, "warning").otherwise("ok")


def rank(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), status), F.lit(1))


def worse(one: Column, two: Column) -> Column:
    """The worse of two; where they rank alike the first stands."""
    return F.when(rank(two) > rank(one), two).otherwise(one)


def capacity(files: DataFrame) -> DataFrame:
    """files (store, chars, entries, char_limit; null chars where there is no file) with percent, pressure of the number of entries, and status, the worse of both."""
    percent = F.round(100 * F.col("chars") / F.col("char_limit"), 1)
    flagged = files.withColumn("percent", percent).withColumn("pressure", entry_pressure(F.col("entries")))
    return flagged.withColumn("status", F.when(F.col("chars").isNull(), "unknown").otherwise(worse(capacity_flag(percent), F.col("pressure"))))


def rollup(checks: DataFrame) -> DataFrame:
    """checks (check, status): the worst status, of those that rank alike the first check's, and the checks that raise it as alerts."""
    first = checks.groupBy(rank(F.col("status")).alias("r")).agg(F.min_by("status", "check").alias("status"))
    return checks.agg(F.array_sort(F.collect_list(F.when(rank(F.col("status")) > 0, F.col("check")))).alias("alerts")).join(first.agg(F.max_by("status", "r").alias("status"))).select("status", "alerts")


def reconcile(live: DataFrame, current: DataFrame) -> DataFrame:
    """live and current (key, hash): new, updated, unchanged or removed for each key, by a full outer join."""
    l, c = live.select("key", F.col("hash").alias("live_hash")), current.select("key", F.col("hash").alias("now_hash"))
    state = F.when(F.col("now_hash").isNull(), "new").when(F.col("live_hash").isNull(), "removed").when(F.col("live_hash") == F.col("now_hash"), "unchanged").otherwise("updated")
    return l.join(c, "key", "full_outer").select("key", state.alias("state"))


def drift(live: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Bag differences of two lists (text), either way; a repeated entry that is gone is a drift."""
    return live.exceptAll(rebuilt).withColumn("side", F.lit("live")).unionByName(rebuilt.exceptAll(live).withColumn("side", F.lit("rebuilt")))


def drift_kind(live_text: Column, rebuilt_text: Column, same_bag: Column) -> Column:
    """exact, whitespace, order or content."""
    flat = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return F.when(live_text == rebuilt_text, "exact").when(flat(live_text) == flat(rebuilt_text), "whitespace").when(same_bag, "order").otherwise("content")


def store_drift(live: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """live and rebuilt entries (store, at, text): per store exact, whitespace, order or content, by sums of hashes instead of whole files.

    Places and texts agree; else the texts without white space agree in order; else as bags; else the contents differ."""
    flat = F.regexp_replace("text", r"(?U)\s+", "")
    digest = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    sums = lambda e, p: e.groupBy("store").agg(digest("at", "text").alias(f"{p}_exact"), digest("at", flat).alias(f"{p}_flat"), digest(F.lit(0), "text").alias(f"{p}_bag"))
    j = sums(live, "x").join(sums(rebuilt, "y"), "store", "full_outer")
    same = lambda k: F.col(f"x_{k}").eqNullSafe(F.col(f"y_{k}"))
    return j.select("store", F.when(same("exact"), "exact").when(same("flat"), "whitespace").when(same("bag"), "order").otherwise("content").alias("drift"))
