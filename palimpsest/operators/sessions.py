"""Session-store analytics and retention: plans what to delete and returns the stores as they would be, never changing their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper ages in days of the histogram's half-open buckets.
AGE_BUCKETS = ((0, 1, "under_1d"), (1, 7, "d1_to_7"), (7, 14, "d7_to_14"), (14, 30, "d14_to_30"), (30, None, "over_30d"))


def with_optional(df: DataFrame, column: str, kind: str) -> DataFrame:
    """df with a typed null column where its schema lacks it; older stores do."""
    return df if column in df.columns else df.withColumn(column, F.lit(None).cast(kind))


def candidate_sessions(sessions: DataFrame, messages: DataFrame, since: Column, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Sessions that started at or after a moment, of the included sources (all where none is named) and of none of the excluded, with their active messages: session_id, source, ord, role, content.

    Messages without the column active are all active. ord counts a session's messages by time, then id."""
    src = F.lower(F.coalesce("source", F.lit("")))
    kept = sessions.where(F.col("started_at") >= since).where(~src.isin(*exclude))
    kept = kept.where(src.isin(*include)) if include else kept
    said = with_optional(messages, "active", "int").where(F.coalesce("active", F.lit(1)) == 1)
    j = said.join(kept.select(F.col("id").alias("session_id"), src.alias("source")), "session_id")
    w = Window.partitionBy("session_id").orderBy("timestamp", "id")
    return j.withColumn("ord", F.row_number().over(w) - 1).select("session_id", "source", "ord", "role", "content")


def first_user_message(messages: DataFrame) -> DataFrame:
    """Each session's first non-blank user message, by (timestamp, id)."""
    said = with_optional(messages, "active", "int").where((F.coalesce("active", F.lit(1)) == 1) & (F.col("role") == "user") & (F.trim("content") != ""))
    return said.groupBy("session_id").agg(F.min_by("content", F.struct("timestamp", "id")).alias("first_message"))


def age_histogram(sessions: DataFrame, now: Column) -> DataFrame:
    """Counts of sessions by days since start; no start is a bucket of its own."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 86_400_000_000
    counts = [F.count_if((age >= lo) & (age < hi) if hi is not None else age >= lo).alias(name) for lo, hi, name in AGE_BUCKETS]
    return sessions.agg(*counts, F.count_if(F.col("started_at").isNull()).alias("unknown"))


def last_activity(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """The last message's time, else the end, else the start."""
    last = messages.groupBy("session_id").agg(F.max("timestamp").alias("_last"))
    return sessions.join(last, sessions["id"] == last["session_id"], "left").drop("session_id").withColumn("last_activity", F.coalesce("_last", "ended_at", "started_at")).drop("_last")


def _before(c: Column, now: Column, days: int) -> Column:
    """Strictly more than so many times 86,400 seconds before now; false where unknown."""
    return F.coalesce(c < now - F.make_dt_interval(F.lit(days)), F.lit(False))


def _free(sources: list[str]) -> Column:
    """Not a protected source; a null source isn't one."""
    return F.col("source").isNull() | ~F.col("source").isin(*sources)


def retention_targets(active: DataFrame, now: Column, days: int, protect_days: int, protected_sources: list[str]) -> DataFrame:
    """Sessions (with last_activity) whose last activity is before the retention's cut and before the protected time, with the reason: closed or unclosed."""
    old = _before(F.col("last_activity"), now, days) & _before(F.col("last_activity"), now, protect_days)
    return active.where(_free(protected_sources) & old).withColumn("reason", F.when(F.col("ended_at").isNotNull(), "closed").otherwise("unclosed"))


def compression_parents(sessions: DataFrame) -> DataFrame:
    """Sessions ended by compression that have a child."""
    children = sessions.where(F.col("parent_session_id").isNotNull()).select(F.col("parent_session_id").alias("id"))
    return sessions.where(F.col("end_reason") == "compression").join(children, "id", "left_semi")


def compression_states(sessions: DataFrame, pruned: DataFrame, now: Column, protect_days: int, protected_sources: list[str]) -> DataFrame:
    """Originals of compressed sessions that started before the protected time, with state: deferred where the session above was compressed too (one generation a run),
    demoted where every child is in pruned, else delete. The top of a chain goes first."""
    ended = sessions.where(F.col("end_reason") == "compression")
    old = ended.where(_before(F.col("started_at"), now, protect_days) & _free(protected_sources))
    kids = sessions.where(F.col("parent_session_id").isNotNull()).select("id", F.col("parent_session_id").alias("_of"))
    lives = kids.join(pruned.select("id", F.lit(True).alias("_pruned")), "id", "left").groupBy("_of").agg(F.bool_or(F.col("_pruned").isNull()).alias("_lives"))
    above = ended.select(F.col("id").alias("parent_session_id"), F.lit(True).alias("_above")).distinct()
    met = old.join(lives, F.col("id") == F.col("_of")).join(above, "parent_session_id", "left")
    return met.select("id", F.when(F.col("_above"), "deferred").when(~F.col("_lives"), "demoted").otherwise("delete").alias("state"))


def collect_targets(active: DataFrame, now: Column, days: int, protect_days: int, protected_sources: list[str], closed: bool = True, unclosed: bool = True, compression: bool = True) -> DataFrame:
    """id, reason of every session that a policy would delete: closed, unclosed or compression_parent (one that both rules name has the first)."""
    kinds = [k for k, on in (("closed", closed), ("unclosed", unclosed)) if on]
    pruned = retention_targets(active, now, days, protect_days, protected_sources).where(F.col("reason").isin(*kinds)).select("id", "reason")
    if not compression:
        return pruned
    parents = compression_states(active, pruned, now, protect_days, protected_sources).where("state = 'delete'").select("id")
    return pruned.unionByName(parents.join(pruned, "id", "left_anti").withColumn("reason", F.lit("compression_parent")))


def target_counts(sessions: DataFrame, messages: DataFrame, gone: DataFrame, states: DataFrame) -> DataFrame:
    """One row of what a deletion of gone (id, reason) comes to; states are those of compression_states."""
    own = gone.agg(F.count("*").alias("sessions_to_delete"), F.count_if(F.col("reason") == "closed").alias("prune_closed"), F.count_if(F.col("reason") == "unclosed").alias("prune_unclosed"))
    comp = states.agg(*[F.count_if(F.col("state") == k).alias(n) for k, n in (("delete", "compression_parents"), ("demoted", "demoted"), ("deferred", "deferred"))])
    lost = messages.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_semi").agg(F.count("*").alias("messages_to_delete"))
    return own.join(comp).join(lost).join(unlinked_children(sessions, gone).agg(F.count("*").alias("children_unlinked")))


def cleanup(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions in gone (id); children of deleted parents lose the link."""
    lost = gone.select(F.col("id").alias("parent_session_id")).distinct().withColumn("_gone", F.lit(True))
    left = sessions.join(gone.select("id").distinct(), "id", "left_anti").join(lost, "parent_session_id", "left")
    left = left.withColumn("parent_session_id", F.when(F.col("_gone").isNull(), F.col("parent_session_id"))).drop("_gone").select(sessions.columns)
    return left, messages.join(gone.select(F.col("id").alias("session_id")).distinct(), "session_id", "left_anti").select(messages.columns)


def unlinked_children(sessions: DataFrame, gone: DataFrame) -> DataFrame:
    return sessions.join(gone.select(F.col("id").alias("parent_session_id")).distinct(), "parent_session_id", "left_semi").join(gone.select("id").distinct(), "id", "left_anti")


def orphans(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages without a session, and sessions whose parent isn't there."""
    a = messages.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti").agg(F.count("*").alias("orphan_messages"))
    up = sessions.where(F.col("parent_session_id").isNotNull()).join(sessions.select(F.col("id").alias("parent_session_id")), "parent_session_id", "left_anti").agg(F.count("*").alias("broken_parents"))
    return a.join(up)


def word_index(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> word, id: an inverted index on lower-cased alphanumeric words."""
    return texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))


def trigram_index(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> gram, id: each different three-character piece."""
    chars = texts.select("id", F.split(F.lower("text"), "").alias("c"))
    # shifted arrays, as a piece by its place would count characters from the text's start each time
    pairs = F.zip_with("c", F.slice("c", 2, F.size("c")), lambda x, y: F.concat(x, y))
    grams = F.filter(F.zip_with(pairs, F.slice("c", 3, F.size("c")), lambda x, y: F.concat(x, y)), lambda g: g.isNotNull())
    return chars.select("id", F.explode(F.array_distinct(grams)).alias("gram"))


def search_impact(texts: DataFrame, words: list[str]) -> DataFrame:
    """Per probe word (lower-case letters and digits) the documents that hold it as a substring, and as a word."""
    # a word is a whole run of letters and digits; words are plain ones, so they need no escapes
    probes = F.explode(F.array(*[F.struct(F.lit(w).alias("probe"), F.contains("low", F.lit(w)).alias("sub"), F.col("low").rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])").alias("word")) for w in words]))
    texts = texts.select(F.lower("text").alias("low"))
    return texts.select(probes.alias("p")).groupBy("p.probe").agg(F.count_if("p.sub").alias("substring_hits"), F.count_if("p.word").alias("word_hits"))
