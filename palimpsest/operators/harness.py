"""The evaluation harness: required recall of what was selected, status policy, and what a grader's findings amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECALL_FLOOR = 0.5


def recall(entries: DataFrame, room: Column) -> DataFrame:
    """entries (task, mode, ref, tokens, required, selected, pinned): per task and mode the counts, and the missed required that could have fit in room tokens."""
    missed = F.col("required") & ~F.col("selected")
    return entries.groupBy("task", "mode").agg(
        F.count_if("required").alias("required"),
        F.count_if(F.col("required") & F.col("selected")).alias("kept"),
        F.count_if("selected").alias("selected"),
        F.count_if(missed & (F.col("tokens") <= room)).alias("droppable"),
        F.count_if(missed & (F.col("tokens") > room)).alias("unfittable"),
        F.count_if(F.col("pinned") & ~F.col("selected")).alias("lost_pins"),
        F.sum("tokens").alias("full_tokens"),
        F.coalesce(F.sum(F.when(F.col("selected"), F.col("tokens"))), F.lit(0)).alias("tokens"),
    )


def task_status(r: DataFrame, floor: float = RECALL_FLOOR) -> DataFrame:
    """A lost pin fails. A missed required entry that would have fit fails below the floor and warns above; one too large for the room only warns. Savings never help."""
    share = F.when(F.col("required") == 0, 1.0).otherwise(F.col("kept") / F.greatest("required", F.lit(1)))
    status = F.when(F.col("lost_pins") > 0, "FAIL").when((F.col("droppable") > 0) & (share < floor), "FAIL").when((F.col("droppable") > 0) | (F.col("unfittable") > 0), "WARN").otherwise("PASS")
    return r.withColumn("status", status)


def mode_rollup(statuses: DataFrame) -> DataFrame:
    """Per mode: token-weighted savings, mean recall, and tasks by status."""
    share = F.when(F.col("required") == 0, 1.0).otherwise(F.col("kept") / F.greatest("required", F.lit(1)))
    return statuses.groupBy("mode").agg((1 - F.sum("tokens") / F.sum("full_tokens")).alias("savings"), F.avg(share).alias("recall"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL")])


def graded(verdicts: DataFrame, floor: float = RECALL_FLOOR) -> DataFrame:
    """verdicts (task, required, pins, preserved, missing, honored, violated: arrays; equivalence, unreachable, parse_error) with missing labels, unconfirmed pins and status.

    What the grader doesn't affirm, or contradicts, counts as missing; a pin on which it is silent is unconfirmed and can't pass."""
    kept = F.array_except(F.array_intersect("required", "preserved"), "missing")
    lost = F.array_except("required", kept)
    broken_pins = F.array_intersect("pins", "violated")
    unsure = F.array_except(F.array_except("pins", "honored"), broken_pins)
    equal = F.when(F.col("equivalence").isin("equivalent", "degraded", "broken"), F.col("equivalence")).otherwise("degraded")
    n = F.size("required")
    status = (
        F.when(F.col("unreachable"), "BLOCKED")
        .when(F.col("parse_error"), "ERROR")
        .when((F.size(broken_pins) > 0) | (equal == "broken"), "FAIL")
        .when((n > 0) & ((n - F.size(lost)) / F.greatest(n, F.lit(1)) < floor), "FAIL")
        .when((F.size(lost) > 0) | (F.size(unsure) > 0) | (equal == "degraded"), "WARN")
        .otherwise("PASS")
    )
    return verdicts.select("task", F.array_sort(lost).alias("lost"), F.array_sort(unsure).alias("unconfirmed"), status.alias("status"))


def valid_tasks(tasks: DataFrame) -> DataFrame:
    """tasks (id, ref_hash, label, pin) rows of entries: what is wrong with each task; no row for sound ones."""
    twice = tasks.groupBy("id", "ref_hash").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate entry").alias("problem"))
    pins = tasks.where(F.col("pin").isNotNull() & ~F.col("pin").isin("safety", "identity", "operational")).select("id", F.lit("bad pin").alias("problem"))
    bare = tasks.groupBy("id").agg(F.count("label").alias("n")).where("n = 0").select("id", F.lit("no label").alias("problem"))
    return twice.union(pins).union(bare).distinct()


def control(entries: DataFrame) -> DataFrame:
    """entries (task, ref, label, required, selected), selected by a run without a budget: per task whether the fixture is valid, i.e. all that is required was selected, and the labels that weren't."""
    missed = F.col("required") & ~F.col("selected")
    return entries.groupBy("task").agg(F.count_if("required").alias("required"), F.array_sort(F.collect_list(F.when(missed, F.col("label")))).alias("missing")).withColumn("valid", F.size("missing") == 0)


def pin_probe(entries: DataFrame) -> DataFrame:
    """entries (task, ref, expected, actual, selected), selected by a run with a budget of 0: per task the pins that didn't survive it, and those that did under another class than expected."""
    pins = entries.where(F.col("expected").isNotNull())
    return pins.groupBy("task").agg(
        F.count("*").alias("pins"), F.array_sort(F.collect_list(F.when(~F.col("selected"), F.col("ref")))).alias("dropped"),
        F.array_sort(F.collect_list(F.when(F.col("selected") & ~F.col("actual").eqNullSafe(F.col("expected")), F.col("ref")))).alias("misclassed"),
    )


def with_controls(statuses: DataFrame, controls: DataFrame, probes: DataFrame) -> DataFrame:
    """Task statuses (task, status) made worse by an invalid fixture or a dropped pin, which fail, and by a pin of another class, which warns."""
    j = statuses.join(controls.select("task", "valid"), "task", "left").join(probes.select("task", "dropped", "misclassed"), "task", "left")
    fail = ~F.coalesce("valid", F.lit(True)) | (F.coalesce(F.size("dropped"), F.lit(0)) > 0)
    warn = F.coalesce(F.size("misclassed"), F.lit(0)) > 0
    return j.withColumn("status", F.when(fail, "FAIL").when(warn & (F.col("status") == "PASS"), "WARN").otherwise(F.col("status"))).drop("valid", "dropped", "misclassed")
