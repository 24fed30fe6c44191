"""Bi-temporal version store: an append-only event log materialised as versions with valid and transaction intervals.

An event has fact_key, event_id, seq, op, store, content, recorded_at and, or null, valid_from and valid_to. All of
a fact's work is one window over fact_key, so history, current and as-of share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DELIMITER, RESTORE_LIMIT
from ..functions.shared import stored
from ..functions.text import LINE_BREAK, content_hash, strip


def last_by_id(events: DataFrame) -> DataFrame:
    """Of events with one id the one with the highest seq stays."""
    w = Window.partitionBy("event_id").orderBy(F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def versions(events: DataFrame) -> DataFrame:
    """Versions in transaction order (recorded_at, seq, event_id). Valid intervals are contiguous: a version ends where its successor's begins, never before its own start; the last keeps its own end."""
    w = Window.partitionBy("fact_key").orderBy("recorded_at", "seq", "event_id")
    start = F.coalesce("valid_from", "recorded_at")
    after = F.lead("event_id").over(w)
    return (
        events.withColumn("version", F.row_number().over(w))
        .withColumn("eff_valid_from", start)
        .withColumn("superseded_at", F.lead("recorded_at").over(w))
        .withColumn("supersedes", F.lag("event_id").over(w))
        .withColumn("superseded_by", after)
        .withColumn("own_valid_to", F.col("valid_to"))
        .withColumn("valid_to", F.when(F.col("superseded_by").isNull(), F.col("valid_to")).otherwise(F.greatest(F.lead("eff_valid_from").over(w), F.col("eff_valid_from"))))
        .withColumn("tombstone", (F.col("op") == "delete").cast("int"))
        .withColumn("is_current", (F.col("superseded_by").isNull() & (F.col("op") != "delete") & F.col("own_valid_to").isNull()).cast("int"))
        .drop("own_valid_to")
    )


def current(v: DataFrame) -> DataFrame:
    """Current versions, by store, then by key where they are shown in order (see in_order)."""
    return v.where("is_current = 1")


def in_order(facts: DataFrame) -> DataFrame:
    """The order that lists of facts are shown in."""
    return facts.orderBy("store", "fact_key", "version")


def history(v: DataFrame, key) -> DataFrame:
    return v.where(F.col("fact_key") == key)


def _bounds(axis: str) -> tuple[str, str]:
    return ("eff_valid_from", "valid_to") if axis == "valid" else ("recorded_at", "superseded_at")


def as_of(v: DataFrame, at: Column, axis: str = "valid") -> DataFrame:
    """The version of each fact that holds at a moment: half-open intervals, a null end is open; of several the latest start, then record, then version. Tombstones are no facts."""
    lo, hi = _bounds(axis)
    w = Window.partitionBy("fact_key").orderBy(F.desc(lo), F.desc("recorded_at"), F.desc("version"))
    held = v.where((F.col(lo).isNull() | (F.col(lo) <= at)) & (F.col(hi).isNull() | (F.col(hi) > at)) & (F.col("tombstone") == 0))
    return held.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def as_of_many(v: DataFrame, moments: DataFrame, axis: str = "valid") -> DataFrame:
    """as_of for each row of moments (moment), a short list of dates; Spark picks the join's form by its size."""
    lo, hi = _bounds(axis)
    met = v.where("tombstone = 0").join(moments, (F.col(lo) <= F.col("moment")) & (F.col(hi).isNull() | (F.col(hi) > F.col("moment"))))
    w = Window.partitionBy("fact_key", "moment").orderBy(F.desc(lo), F.desc("recorded_at"), F.desc("version"))
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


SEGMENT = r"(?<=[.;|])\s+"


def _unified(before, after):
    """Unified difference of two lists of segments, as lines."""
    import difflib

    import pandas as pd

    return pd.Series(["\n".join(difflib.unified_diff(list(a), list(b), fromfile="before", tofile="after", lineterm="")) for a, b in zip(before, after, strict=True)])


def changed_between(v: DataFrame, one: Column, two: Column, axis: str = "valid", unified: bool = False) -> DataFrame:
    """Facts at two moments with their versions and contents (empty where there is none), whether the contents differ when stripped, and the segments that only one side has.

    Both moments come from one scan: a fact's versions are ranked per moment, so the version window isn't made twice."""
    lo, hi = _bounds(axis)
    moments = F.explode(F.array(F.struct(F.lit("a").alias("side"), one.alias("at")), F.struct(F.lit("b").alias("side"), two.alias("at"))))
    met = v.where("tombstone = 0").select("fact_key", "version", "content", "recorded_at", F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), moments.alias("m"))
    held = met.where((F.col("_lo").isNull() | (F.col("_lo") <= F.col("m.at"))) & (F.col("_hi").isNull() | (F.col("_hi") > F.col("m.at"))))
    side = lambda x: F.max_by(F.struct("version", "content"), F.when(F.col("m.side") == x, F.struct("_lo", "recorded_at", "version")))
    both = held.groupBy("fact_key").agg(side("a").alias("_a"), side("b").alias("_b"))
    text = lambda x: F.coalesce(F.col(f"{x}.content"), F.lit(""))
    out = both.select("fact_key", F.col("_a.version").alias("from_version"), F.col("_b.version").alias("to_version"), text("_a").alias("before"), text("_b").alias("after"))
    pieces = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, SEGMENT))
    out = out.withColumn("changed", strip(F.col("before")) != strip(F.col("after")))
    out = out.withColumn("removed", F.array_except(pieces("before"), pieces("after"))).withColumn("added", F.array_except(pieces("after"), pieces("before")))
    return out.withColumn("unified", F.pandas_udf(_unified, "string")(pieces("before"), pieces("after"))) if unified else out


def prune(v: DataFrame, cutoff: Column, keep: int) -> DataFrame:
    """Adds hot: the birth, the last `keep` versions and whatever is younger than the cutoff stay hot."""
    up = Window.partitionBy("fact_key").orderBy("version")
    down = Window.partitionBy("fact_key").orderBy(F.desc("version"))
    return v.withColumn("hot", (F.row_number().over(up) == 1) | (F.row_number().over(down) <= keep) | (F.col("recorded_at") >= cutoff))


def record_runs(events: DataFrame) -> DataFrame:
    """Events that are recorded: those whose stripped content differs from the fact's event before them in transaction order, or that follow a deletion or are one.
    Going back to an older content is a change."""
    w = Window.partitionBy("fact_key").orderBy("recorded_at", "seq", "event_id")
    same = (F.lag("op").over(w) != "delete") & (F.lag(content_hash(F.coalesce("content", F.lit("")))).over(w) == content_hash(F.coalesce("content", F.lit(""))))
    return events.withColumn("_same", F.coalesce(same, F.lit(False)) & (F.col("op") != "delete")).where("not _same").drop("_same")


def first_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("store", "fact_key").agg(F.min("seq").alias("first_seq"))


def reconstruct(v: DataFrame) -> DataFrame:
    """store, first_seq, fact_key, content: the current facts as the entries of each store's file; first_seq, when a fact was first seen, is their order."""
    order = v.groupBy("store", "fact_key").agg(F.min("seq").alias("first_seq"))
    return current(v).join(order, ["store", "fact_key"]).select("store", "first_seq", "fact_key", "content")


def store_stats(v: DataFrame) -> DataFrame:
    return v.agg(
        F.count("*").alias("versions"),
        F.count_distinct("fact_key").alias("facts"),
        F.sum("is_current").alias("current_facts"),
        F.sum("tombstone").alias("tombstones"),
        F.min("recorded_at").alias("first_recorded"),
        F.max("recorded_at").alias("last_recorded"),
    )


def linked_facts(v: DataFrame, one: Column, two: Column) -> DataFrame:
    """Facts that have events of both kinds."""
    return v.groupBy("fact_key").agg(F.bool_or(one).alias("one"), F.bool_or(two).alias("two")).where("one and two").select("fact_key")


def match(entries: DataFrame, known: DataFrame, tokens: Column, threshold: float) -> DataFrame:
    """DUPLICATE by hash, else UPDATE by key, else UPDATE by the nearest known fact of Jaccard >= threshold (pointers aside), else NEW; each within the entry's store.

    entries: ref, store, hash, key, is_pointer, tokens; known: store, fact_key, hash, tokens, the current facts. The fuzzy step is an equi-join on the tokens of prefixes,
    each word with its store, so stores never meet."""
    from .similarity import nearest

    by_hash = known.groupBy("store", "hash").agg(F.min("fact_key").alias("hash_key"))
    by_key = known.select("store", F.col("fact_key").alias("key")).distinct().withColumn("key_hit", F.lit(True))
    scoped = lambda t: F.transform(t, lambda w: F.concat_ws("\n", "store", w))
    near = nearest(entries.where(~F.col("is_pointer")).select(F.col("ref").alias("id"), scoped(tokens).alias("tokens")), known.select(F.struct("store", "fact_key").alias("id"), scoped(F.col("tokens")).alias("tokens")), threshold)
    near = near.select(F.col("id").alias("ref"), F.col("best_id.fact_key").alias("fuzzy_key"), F.round("score", 3).alias("fuzzy_score"))
    return (
        entries.join(by_hash, ["store", "hash"], "left")
        .join(by_key, ["store", "key"], "left")
        .join(near, "ref", "left")
        .withColumn("decision", F.when(F.col("hash_key").isNotNull(), "DUPLICATE").when(F.col("key_hit"), "UPDATE").when(F.col("fuzzy_key").isNotNull(), "UPDATE").otherwise("NEW"))
        .withColumn("how", F.when(F.col("hash_key").isNotNull(), "hash").when(F.col("key_hit"), "key").when(F.col("fuzzy_key").isNotNull(), "fuzzy"))
        .withColumn("fact_key", F.coalesce("hash_key", F.when(F.col("key_hit"), F.col("key")), "fuzzy_key", "key"))
    )


#: A key that the numbering may have made of another: its stem and number, from 2 on and without zeros in front.
NUMBERED = r"^(.*)-([2-9]|[1-9]\d+)$"


def number_collisions(matched: DataFrame) -> DataFrame:
    """matched (store, ref, fact_key, hash, decision) with keys made unique in a pass: entries are placed in order of ref, the first content of a key keeps it, and each further content gets the first of -2, -3, ...
    that no content placed before it has, by asking for it or by the numbering, and is NEW; a content that was placed under the key already shares its place.

    A key's contents that go on to a number are counted by a window, and where keys that were asked for lie in the way (x-2 beside x), they are told apart in a small table of such keys: whether it was asked for before
    the numbering came to it, which then skips it, or after, when its own contents go on to x-2-2. Each key's answer depends on its stem's and on smaller numbers' alone, so repeating until nothing changes ends."""
    items = stored(matched.groupBy("store", "fact_key", "hash").agg(F.min("ref").alias("at")), "placed")
    groups = items.groupBy("store", "fact_key").agg(F.min("at").alias("asked"))
    number = F.regexp_extract("fact_key", NUMBERED, 2).try_cast("long")
    stems = groups.select("store", F.col("fact_key").alias("stem"))
    inner = groups.where(number.isNotNull()).withColumns({"stem": F.regexp_extract("fact_key", NUMBERED, 1), "n": number}).join(stems, ["store", "stem"])
    inner = stored(inner.select("store", "fact_key", "stem", "n", "asked", F.lit(False).alias("skip"), F.lit(None).cast(matched.schema["ref"].dataType).alias("taken")), "numbered")

    def over(state):
        """Contents that go on to a number, and which of them they are under their key: 1, 2, ..."""
        w = Window.partitionBy("store", "fact_key").orderBy("at")
        gone = state.where("taken is not null").select("store", "fact_key", F.lit(1).alias("gone"))
        return items.join(gone, ["store", "fact_key"], "left").withColumn("j", F.row_number().over(w) - 1 + F.coalesce("gone", F.lit(0))).drop("gone")

    def met(state):
        """n - 1 - the smaller numbers that are skipped: which of the stem's contents comes to this key's number."""
        before = Window.partitionBy("store", "stem").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        return state.withColumn("j", F.col("n") - 1 - F.coalesce(F.sum(F.col("skip").cast("long")).over(before), F.lit(0)))

    while not inner.isEmpty():
        comes = over(inner).select("store", F.col("fact_key").alias("stem"), "j", F.col("at").alias("comes"))
        told = met(inner).join(comes.where("j > 0"), ["store", "stem", "j"], "left").withColumns({"_skip": F.coalesce(F.col("asked") < F.col("comes"), F.lit(False)), "_taken": F.when(F.col("comes") < F.col("asked"), F.col("comes"))})
        told = stored(told.select("store", "fact_key", "stem", "n", "asked", "skip", "taken", "_skip", "_taken"), "numbered")
        changed = told.where((F.col("skip") != F.col("_skip")) | ~F.col("taken").eqNullSafe(F.col("_taken")))
        inner = told.select("store", "fact_key", "stem", "n", "asked", F.col("_skip").alias("skip"), F.col("_taken").alias("taken"))
        if changed.isEmpty():
            break
    # each skipped number shifts the contents that come after it
    shifts = met(inner).where("skip").select("store", F.col("stem").alias("fact_key"), "j", F.lit(1).alias("up"))
    both = over(inner).select("store", "fact_key", F.col("j").cast("long").alias("j"), "hash", F.lit(0).alias("up")).unionByName(shifts.withColumn("hash", F.lit(None).cast("string")))
    upto = Window.partitionBy("store", "fact_key").orderBy("j", F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_n", F.when(F.col("j") > 0, F.col("j") + 1 + F.sum("up").over(upto))).where("up = 0").drop("j", "up")
    again = F.col("_n").isNotNull()
    j = matched.join(placed, (matched["store"] == placed["store"]) & (matched["fact_key"] == placed["fact_key"]) & matched["hash"].eqNullSafe(placed["hash"])).drop(placed["store"], placed["fact_key"], placed["hash"])
    return j.withColumn("decision", F.when(again, "NEW").otherwise(F.col("decision"))).withColumn("fact_key", F.when(again, F.concat_ws("-", "fact_key", F.col("_n").cast("string"))).otherwise(F.col("fact_key"))).drop("_n")


def ingest(entries: DataFrame, current_facts: DataFrame, archived: DataFrame, threshold: float) -> DataFrame:
    """What a pass over the live files records: store, fact_key, op, content, archived_at and ref (null for what vanished).

    entries: as for match, with text; current_facts: store, fact_key, hash, tokens, content; archived (fact_key, content, archived_at): blocks of archives.
    An entry whose place holds its content already records nothing (op null); a current fact that no entry touches is archived by its latest block, else deleted."""
    m = number_collisions(match(entries, current_facts, F.col("tokens"), threshold))
    now = current_facts.select("store", "fact_key", F.col("hash").alias("_hash"))
    j = m.join(now, ["store", "fact_key"], "left")
    op = F.when(F.col("_hash").eqNullSafe(F.col("hash")), None).when(F.col("decision") == "NEW", "create").otherwise("update")
    none = F.lit(None)
    live = j.select("store", "fact_key", op.alias("op"), F.col("text").alias("content"), none.cast("string").alias("archived_at"), "ref")
    last = archived.groupBy("fact_key").agg(F.max_by(F.struct("content", "archived_at"), F.struct("archived_at", "content")).alias("_b"))
    gone = current_facts.join(m.select("store", "fact_key"), ["store", "fact_key"], "left_anti").join(last, "fact_key", "left")
    lost = gone.select("store", "fact_key", F.when(F.col("_b").isNotNull(), "archive").otherwise("delete").alias("op"), F.coalesce("_b.content", "content").alias("content"), F.col("_b.archived_at").cast("string").alias("archived_at"), none.cast(entries.schema["ref"].dataType).alias("ref"))
    return live.unionByName(lost)


def ingest_archives(blocks: DataFrame, events: DataFrame) -> DataFrame:
    """blocks (fact_key, hash, content, archived, ...) that no event of their fact has by hash, each content once: the rest are on record already."""
    once = blocks.withColumn("_n", F.row_number().over(Window.partitionBy("fact_key", "hash").orderBy("archived", "content"))).where("_n = 1").drop("_n")
    return once.join(events.select("fact_key", "hash").distinct(), ["fact_key", "hash"], "left_anti")


def rebuild_guard(events: DataFrame, versions_held: int, claimed: int, log_exists: bool, force: bool = False) -> None:
    """Refuses to replace a filled index by an empty one when the log has gone."""
    if not force and (versions_held or claimed) and not log_exists and events.isEmpty():
        raise ValueError(f"the event log is missing but the index holds {versions_held} versions and its record claims {claimed} events")


def restore(v: DataFrame, at: Column | None = None, version: int | None = None, limit: int = RESTORE_LIMIT) -> DataFrame:
    """The version of each fact to go back to (by number, by moment on the valid axis, else the last), and why it may not be written: delimiter or length."""
    if version is not None:
        picked = v.where(F.col("version") == version)
    elif at is not None:
        picked = as_of(v, at)
    else:
        picked = v.withColumn("_n", F.row_number().over(Window.partitionBy("fact_key").orderBy(F.desc("version")))).where("_n = 1").drop("_n")
    refused = F.when(has_delimiter(F.col("content")), "delimiter").when(F.length("content") > limit, "length")
    return picked.withColumn("refused", refused)


def has_delimiter(c: Column) -> Column:
    """Whether a text would end an entry where it stands in a store's file."""
    return F.contains(c, F.lit(DELIMITER)) | F.exists(F.split(c, LINE_BREAK), lambda line: strip(line) == strip(F.lit(DELIMITER)))


def parse_dt(c: Column) -> Column:
    """A date, date and time or epoch second in text as an ISO-8601 instant in UTC without fractions; null where it can't be read, blank or null."""
    t = strip(c)
    number = F.timestamp_seconds(t.try_cast("bigint"))
    zoned = F.regexp_replace(t, "Z$", "+00:00")
    has_zone = zoned.rlike(r"[+-]\d{2}:?\d{2}(:?\d{2})?$") & (F.length(t) > 10)
    # a time without a zone is UTC: read in the session's zone, then taken as its own wall clock
    naive = F.when(has_zone, F.try_to_timestamp(zoned)).otherwise(F.convert_timezone(F.lit("UTC"), F.current_timezone(), t.try_cast("timestamp_ntz")).cast("timestamp"))
    moment = F.when(t.rlike(r"^\d{9,11}$"), number).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), naive)
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.date_trunc("second", moment).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
