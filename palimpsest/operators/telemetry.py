"""Telemetry of projections: the last event per turn, rates, percentiles, lane feedback, and the rollout decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FEEDBACK_DECAY_DAYS, FEEDBACK_MIN_ANSWERS, FEEDBACK_MIN_EVENTS, FEEDBACK_WINDOW_DAYS, GATE_ANSWERS, GATE_DAEMON, GATE_MISSING, GATE_P95, GATE_SAVINGS, GATE_SUBPROCESS, LANE_WEIGHTS


def latest_per_turn(events: DataFrame) -> DataFrame:
    """The event of each turn generated last, the later line where equal."""
    w = Window.partitionBy("turn_id").orderBy(F.desc("generated_at"), F.desc("ordinal"))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: What marks a relevance source as semantic, unless it says that it is disabled.
SEMANTIC = ("memories-index:", "semantic", "subprocess:", "direct")
DISABLED = "disabled:"
CRITICAL_PINS = ("safety", "identity", "operational")


def is_semantic(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    return low.rlike("|".join(SEMANTIC)) & ~F.startswith(low, F.lit(DISABLED))


def summary(turns: DataFrame) -> DataFrame:
    """One row of measures of turns (one row each: savings, tokens, full_tokens, selected, skipped, over_budget, active_block, raw_blocks, source, path (null without telemetry),
    latency, hits, requested, pool, skipped_pins, safety_drops, answered, missing, critical_missing). Means have two places, p95 is the nearest rank.

    The exact percentile keeps one counter per different value."""
    told, answered = F.col("path").isNotNull(), F.col("answered")
    mean = lambda c, when=None: F.coalesce(F.round(F.avg(c if when is None else F.when(when, F.col(c))), 2), F.lit(0.0))
    p95 = lambda c: F.coalesce(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})"), F.lit(0))
    share = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    events = F.count_if(told)
    return turns.withColumn("_latency", F.when(told, F.col("latency"))).agg(
        F.count("*").alias("turns"), mean("savings").alias("avg_savings"), F.coalesce(F.min("savings"), F.lit(0)).alias("min_savings"),
        p95("tokens").alias("p95_tokens"), mean("tokens").alias("avg_tokens"), mean("full_tokens").alias("avg_full_tokens"), mean("selected").alias("avg_selected"), mean("skipped").alias("avg_skipped"),
        share(F.count_if(is_semantic(F.col("source"))), F.count("*")).alias("semantic_rate"), events.alias("telemetry"), share(events, F.count("*")).alias("telemetry_rate"),
        share(F.count_if(F.col("path") == "daemon"), events).alias("daemon_rate"), share(F.count_if(F.col("path") == "subprocess"), events).alias("subprocess_rate"),
        p95("_latency").alias("p95_latency"), mean("_latency").alias("avg_latency"), mean("hits", told).alias("avg_hits"), mean("requested", told).alias("avg_requested"), mean("pool", told).alias("avg_pool"),
        F.count_if(answered).alias("answers"), total(F.when(answered, F.col("missing"))).alias("missing"), total(F.when(answered, F.col("critical_missing"))).alias("critical_missing"),
        share(total(F.when(answered, F.col("missing"))), F.count_if(answered)).alias("missing_rate"), F.count_if("raw_blocks").alias("raw_blocks"), F.count_if("over_budget").alias("over_budget"),
        F.count_if(~F.col("active_block").eqNullSafe(F.lit("full"))).alias("active_not_full"), total("safety_drops").alias("safety_drops"), total("skipped_pins").alias("skipped_pins"),
    )


def gate_status(s: DataFrame, require_semantic: bool = True) -> DataFrame:
    """A summary row, with errors (unreadable inputs) and violations (replay groups with several hashes), with its failures and warnings, the status and the decision, which is the status."""
    some, told = F.col("turns") > 0, F.col("telemetry") > 0
    failures = {
        "input_errors": F.col("errors") > 0, "no_events": ~some, "active_block": F.col("active_not_full") > 0, "raw_blocks": F.col("raw_blocks") > 0, "over_budget": F.col("over_budget") > 0,
        "safety_pins": F.col("safety_drops") > 0, "determinism": F.col("violations") > 0, "critical_pins": F.col("critical_missing") > 0, "telemetry": some & (F.col("telemetry_rate") < 1),
        "daemon": told & (F.col("daemon_rate") < GATE_DAEMON), "subprocess": told & (F.col("subprocess_rate") > GATE_SUBPROCESS), "latency": told & (F.col("p95_latency") > GATE_P95),
    }
    warnings = {
        "savings": some & (F.col("avg_savings") < GATE_SAVINGS), "semantic": some & F.lit(require_semantic) & (F.col("semantic_rate") < 1), "no_answers": F.col("answers") == 0,
        "few_answers": (F.col("answers") > 0) & (F.col("answers") < GATE_ANSWERS), "missing": (F.col("answers") >= GATE_ANSWERS) & (F.col("missing_rate") > GATE_MISSING), "skipped_pins": F.col("skipped_pins") > 0,
    }
    said = lambda tests: F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))
    out = s.withColumn("failures", said(failures)).withColumn("warnings", said(warnings))
    status = F.when(F.size("failures") > 0, "FAIL").when(F.size("warnings") > 0, "WARN").otherwise("PASS")
    return out.withColumn("status", status).withColumn("decision", F.col("status"))


def top_refs(rows: DataFrame, n: int = 20) -> DataFrame:
    """rows (ref, ordinal): the n most frequent refs, the one met first where equal: a report's list."""
    return rows.groupBy("ref").agg(F.count("*").alias("times"), F.min("ordinal").alias("first_seen")).orderBy(F.desc("times"), "first_seen").limit(n)


def determinism(rows: DataFrame) -> DataFrame:
    """rows (grp, hash): groups that should always give one hash and didn't."""
    return rows.groupBy("grp").agg(F.count_distinct("hash").alias("hashes"), F.count("*").alias("events")).where("hashes > 1")


def lane_feedback(events: DataFrame, today: Column) -> DataFrame:
    """events (lane, turn_id, ordinal, day, path, missing, selected, answered): a turn counts once per lane, its first line; within the window, weights fall by e each decay period."""
    w = Window.partitionBy("lane", "turn_id").orderBy("ordinal")
    e = events.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("age", F.datediff(today, F.col("day"))).where(F.col("age").isNull() | (F.col("age") <= FEEDBACK_WINDOW_DAYS))
    weight = F.when(F.col("age").isNull(), 1.0).otherwise(F.exp(-F.col("age") / float(FEEDBACK_DECAY_DAYS)))
    a = e.groupBy("lane").agg(
        F.count("*").alias("events"),
        F.count_if("answered").alias("answers"),
        F.count_if(F.col("path") == "subprocess").alias("subprocess"),
        F.sum(F.when(F.col("answered"), weight)).alias("wa"),
        F.sum(F.when(F.col("answered"), weight * F.col("missing"))).alias("wm"),
        F.sum(F.when(F.col("answered"), weight * F.col("selected"))).alias("ws"),
    )
    rate = lambda c: F.when(F.col("answers") > 0, F.col(c) / F.greatest("wa", F.lit(1e-9))).otherwise(0.0)
    met = (F.col("events") >= FEEDBACK_MIN_EVENTS) & (F.col("answers") >= FEEDBACK_MIN_ANSWERS)
    sub = F.col("subprocess") / F.greatest("events", F.lit(1))
    moved = F.least(F.lit(0.35), rate("ws") * 0.1) - F.least(F.lit(0.6), rate("wm")) - F.least(F.lit(0.4), sub)
    adjusted = F.when(met, F.greatest(F.lit(-0.75), F.least(F.lit(0.5), moved))).otherwise(0.0)
    health = F.when(~met, "insufficient").when((rate("wm") > 0) | (sub > 0), "warn").otherwise("ok")
    return a.select("lane", "events", "answers", rate("wm").alias("missing_rate"), rate("ws").alias("selected_rate"), adjusted.alias("adjustment"), health.alias("health"))


def rank_lanes(lanes: DataFrame) -> DataFrame:
    """lanes (query_id, lane, lane_order, intent, topic, availability, adjustment) with score and rank."""
    w = LANE_WEIGHTS
    score = w["intent"] * F.when(F.col("intent"), 1.0).otherwise(0.0) + w["topic"] * F.col("topic") + w["availability"] * F.col("availability") + w["feedback"] * F.col("adjustment")
    ranked = lanes.withColumn("score", score)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "lane_order")))
