"""The search map: what each store holds, which lane a question should take, and whether the stores are sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LANE_WEIGHTS
from ..functions import patterns as P
from ..functions.text import query_terms, says

#: Lanes in order with the store that backs each, and what a store's state is worth.
LANES = (("memory-entry", "semantic_memories"), ("session-semantic", "semantic_sessions"), ("temporal", "temporal"), ("notes-canonical", "notes_index"), ("source-code", None), ("spine", "spine"))
AVAILABILITY = {"ok": 1.0, "stale": 0.4, "degraded": 0.2, "n/a": 0.5, "missing": 0.0}
#: Stores whose absence or age is worth a warning.
OPTIONAL = ("user_memory", "notes_index", "master_index", "temporal", "shadow_report")


def lanes() -> Column:
    """The lanes as an array of (lane, lane_order, store)."""
    return F.array(*[F.struct(F.lit(lane).alias("lane"), F.lit(i).alias("lane_order"), F.lit(store).cast("string").alias("store")) for i, (lane, store) in enumerate(LANES)])


def intent(question: Column, lane: Column) -> Column:
    """Whether the question's words ask for the lane."""
    out = F.lit(False)
    for name, pattern in P.INTENTS.items():
        out = F.when(lane == name, says(F.coalesce(question, F.lit("")), pattern)).otherwise(out)
    return out


def availability(present: Column, status: Column, fresh: Column, daemon: Column | None = None) -> Column:
    """ok, stale, degraded or missing. A store behind the daemon (daemon not null) is ok or degraded."""
    plain = F.when(~F.coalesce(present, F.lit(False)), "missing").when(~status.eqNullSafe(F.lit("ok")), "degraded").when(~F.coalesce(fresh, F.lit(True)), "stale").otherwise("ok")
    if daemon is None:
        return plain
    return F.when(daemon.isNotNull(), F.when((daemon == "up") & status.eqNullSafe(F.lit("ok")), "ok").otherwise("degraded")).otherwise(plain)


def topic_matches(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """questions (query_id, question) and topics (lane, key, where, source, terms): query_id, lane, key, where, source, matched (words) and match, the share of the question's words that the
    topic has, best one per key and place. An equi-join on words."""
    asked = questions.select("query_id", F.array_distinct(query_terms(F.col("question"))).alias("terms"))
    words = asked.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    held = topics.select("lane", "key", "where", "source", F.xxhash64("lane", "key", "where", "source", "terms").alias("_topic"), F.explode(F.array_distinct("terms")).alias("term"))
    met = words.join(held, "term").groupBy("query_id", "lane", "key", "where", "source", "_topic", "n").agg(F.array_sort(F.collect_list("term")).alias("matched"))
    scored = met.withColumn("match", F.round(F.size("matched") / F.col("n"), 3))
    w = Window.partitionBy("query_id", "lane", "key", "where").orderBy(F.desc("match"), "source", "_topic")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_topic", "n")


def rank(questions: DataFrame, matches: DataFrame, stores: DataFrame, feedback: DataFrame) -> DataFrame:
    """A row for each question and lane: intent, topic, availability, adjustment, score (three places), signal, rank and the three best matched keys.

    matches: topic_matches; stores (store, availability); feedback (lane, adjustment). Six lanes a question; the tables joined to them are as short as the lists of lanes and stores."""
    w = LANE_WEIGHTS
    best = matches.groupBy("query_id", "lane").agg(F.max("match").alias("topic"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("match")).alias("m"), "key", "source"))), 1, 3).alias("top"))
    rows = questions.select("query_id", "question", F.explode(lanes()).alias("l")).select("query_id", "question", "l.*")
    j = rows.join(best, ["query_id", "lane"], "left").join(stores, "store", "left").join(feedback.select("lane", "adjustment"), "lane", "left")
    worth = F.create_map(*[F.lit(x) for kv in AVAILABILITY.items() for x in kv])
    state = F.when(F.col("store").isNull(), "n/a").otherwise(F.coalesce("availability", F.lit("missing")))
    asks = intent(F.col("question"), F.col("lane"))
    signal = w["intent"] * asks.cast("double") + w["topic"] * F.coalesce("topic", F.lit(0.0))
    j = j.withColumn("intent", asks).withColumn("topic", F.coalesce("topic", F.lit(0.0))).withColumn("availability", state).withColumn("adjustment", F.coalesce("adjustment", F.lit(0.0)))
    j = j.withColumn("signal", F.round(signal, 3)).withColumn("score", F.round(signal + w["availability"] * F.try_element_at(worth, state) + w["feedback"] * F.col("adjustment"), 3))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "lane_order")))


def route_packets(ranked: DataFrame) -> DataFrame:
    """A row a question: its words, the recommended lane, its score as confidence, the store to look in where all its topics are of one, the matched keys, and whether anything but availability spoke."""
    spoke = ranked.groupBy("query_id").agg(F.bool_or(F.col("signal") > 1e-9).alias("matched"))
    top = ranked.where("rank = 1").join(spoke, "query_id")
    kept = F.array_distinct(F.transform(F.filter(F.coalesce("top", F.array().cast(ranked.schema["top"].dataType)), lambda t: t["source"].isin("hot_memory", "user_memory")), lambda t: t["source"]))
    where = F.when((F.col("lane") == "memory-entry") & (F.size(kept) == 1), F.when(F.get(kept, F.lit(0)) == "user_memory", "user").otherwise("memory"))
    keys = F.coalesce(F.transform("top", lambda t: t["key"]), F.array().cast("array<string>"))
    return top.select("query_id", F.array_sort(F.array_distinct(query_terms(F.col("question")))).alias("query_terms"), F.col("lane").alias("recommended_lane"), F.col("score").alias("confidence"), where.alias("memory_where"), keys.alias("matched_keys"), "matched")


def doctor(stores: DataFrame) -> DataFrame:
    """stores (store, present, status, fresh, daemon): one row of failures, warnings and status. Only the hot memory is required; the daemon and the optional stores warn; a spine only when it is there."""
    name, sound = F.col("store"), F.col("status").eqNullSafe(F.lit("ok"))
    there, fresh = F.coalesce("present", F.lit(False)), F.coalesce("fresh", F.lit(True))
    fail = F.when(name == "hot_memory", F.when(~there, F.lit("hot_memory missing")).when(~sound, F.lit("hot_memory unreadable")))
    state = F.when(~there, "missing").when(~sound, "degraded").when(~fresh, "stale")
    warn = (
        F.when((name == "hot_memory") & there & sound & ~fresh, "hot_memory stale")
        .when(name.isin(*OPTIONAL), F.concat(name, F.lit(" "), state))
        .when((name == "semantic") & ~F.col("daemon").eqNullSafe(F.lit("up")), "semantic daemon down")
        .when((name == "spine") & there & ~sound, "spine unreadable")
    )
    seen = stores.agg(F.array_sort(F.collect_list(fail)).alias("failures"), F.array_sort(F.collect_list(warn)).alias("warnings"), F.collect_set(name).alias("_seen"))
    unseen = lambda names, said: F.transform(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: ~F.array_contains("_seen", n)), lambda n: F.concat(n, F.lit(said)))
    out = seen.withColumn("failures", F.concat("failures", unseen(["hot_memory"], " missing"))).withColumn("warnings", F.array_sort(F.concat("warnings", unseen(OPTIONAL, " missing"), unseen(["semantic"], " daemon down"))))
    return out.withColumn("status", F.when(F.size("failures") > 0, "FAIL").when(F.size("warnings") > 0, "WARN").otherwise("PASS")).drop("_seen")
