"""Queries over the version store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.shared import shared_dir, stored
from ..operators import temporal as T
from ..sources.files import append_events, split_cold
from ..sources.versioned import read_table
from .bind import VERSION_EVENTS_SQL, VERSIONS_SQL, version_events

AT, LATER, CUTOFF, KEEP = "2024-01-10 12:00:00", "2024-01-20 12:00:00", "2024-01-25 00:00:00", 3
OUT = ["fact_key", "event_id", "store", "version", "op", "content", "recorded_at", "eff_valid_from", "valid_to", "superseded_at", "supersedes", "superseded_by", "is_current", "tombstone"]
OUT_SQL = ", ".join(OUT)


def _v(spark, d):
    return T.versions(version_events(spark, d))


def _ts(x):
    return F.lit(x).cast("timestamp_ntz")


def version_history(spark, d):
    return _v(spark, d).select(OUT)


def current_facts(spark, d):
    return T.current(_v(spark, d)).select("fact_key", "store", "version", "content")


def fact_history(spark, d):
    return T.history(_v(spark, d), 7).select(OUT)


def first_seen_order(spark, d):
    return T.first_seen(version_events(spark, d))


def as_of_valid(spark, d):
    return T.as_of(_v(spark, d), _ts(AT)).select("fact_key", "version", "content", "eff_valid_from", "valid_to")


def as_of_transaction(spark, d):
    return T.as_of(_v(spark, d), _ts(AT), "transaction").select("fact_key", "version", "content", "recorded_at", "superseded_at")


def as_of_many_dates(spark, d):
    moments = spark.range(1, 8).select((F.lit("2024-01-01 06:00:00").cast("timestamp_ntz") + F.make_interval(days=(F.col("id") * 4).cast("int"))).cast("timestamp_ntz").alias("moment"))
    return T.as_of_many(_v(spark, d), moments).select("moment", "fact_key", "version", "content")


def temporal_stats(spark, d):
    return T.store_stats(_v(spark, d))


def facts_with_history(spark, d):
    return _v(spark, d).groupBy("fact_key").agg(F.count("*").alias("versions")).where("versions > 1").agg(F.count("*").alias("facts_with_history"))


def linked_facts(spark, d):
    return T.linked_facts(_v(spark, d), F.col("op") == "create", F.col("op") == "delete")


def prune_hot(spark, d):
    return T.prune(_v(spark, d), _ts(CUTOFF), KEEP).where("hot").select("fact_key", "event_id", "version")


def prune_cold(spark, d):
    return T.prune(_v(spark, d), _ts(CUTOFF), KEEP).where("not hot").select("fact_key", "event_id", "version")


def split_tables(spark, d):
    """Hot and cold as they are read back from the tables that they were committed to, in two runs, the first with a laxer bound."""
    at = f"{shared_dir(spark)}/split-{uuid.uuid4().hex}"
    v = stored(_v(spark, d), "split")
    split_cold(v, _ts(CUTOFF), 2 * KEEP, f"{at}/hot", f"{at}/cold")
    hot, cold = split_cold(v, _ts(CUTOFF), KEEP, f"{at}/hot", f"{at}/cold")
    return hot.select("fact_key", "event_id", "version", F.lit(True).alias("hot")).union(cold.select("fact_key", "event_id", "version", F.lit(False)))


def appended_log(spark, d):
    """The event log as batches of days were appended to it, each tried twice, as a stream does after a failure: fact, events, and a digest of their ids."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    e = stored(version_events(spark, d).withColumn("batch", F.dayofmonth("recorded_at") % 4), "events")
    for k in range(4):
        for _ in range(2):
            append_events(e.where(F.col("batch") == k).drop("batch"), path, "days", k)
    return read_table(spark, path).groupBy("fact_key").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


def diff_changed_facts(spark, d):
    c = T.changed_between(_v(spark, d), _ts(AT), _ts(LATER))
    return c.select("fact_key", "from_version", "to_version", "before", "after", "changed", F.size("removed").alias("removed"), F.size("added").alias("added"))


def record_dedup_runs(spark, d):
    return T.record_runs(version_events(spark, d)).select("fact_key", "event_id", "content")


def last_writer_wins(spark, d):
    """Each event written twice, the second time with another content: the later line stays."""
    e = version_events(spark, d)
    twice = e.unionByName(e.where("event_id % 3 = 0").withColumns({"content": F.concat("content", F.lit("!")), "seq": F.col("seq") + 1_000_000}))
    return T.last_by_id(twice).select("event_id", "fact_key", "content")


def restore_candidates(spark, d):
    """The version each fact would go back to at a moment, where it differs from the current one and is within the entry limit."""
    v = _v(spark, d)
    then = T.as_of(v, _ts(AT), "transaction").select("fact_key", "version", F.col("content").alias("restored"))
    now = T.current(v).select("fact_key", "content")
    return then.join(now, "fact_key", "left").where(~F.col("restored").eqNullSafe(F.col("content")) & (F.length("restored") <= 2000)).select("fact_key", "version", "restored", F.when(F.col("content").isNull(), "append").otherwise("replace").alias("how"))


def reconstructed_stores(spark, d):
    """Each store's file from its current facts in the order they were first seen: entries, characters, and a digest of places and contents."""
    r = T.reconstruct(_v(spark, d))
    return r.groupBy("store").agg(F.count("*").alias("entries"), F.sum(F.length("content")).alias("chars"), F.sum(X.text_digest(F.col("first_seq"), F.col("content"))).cast("string").alias("digest"))


def restored(spark, d):
    """What each selector would restore: version 2, a moment, or the last version, and why it may not be written."""
    v = _v(spark, d)
    one = lambda name, df: df.select(F.lit(name).alias("selector"), "fact_key", "version", "refused")
    return one("version", T.restore(v, version=2)).unionByName(one("moment", T.restore(v, at=_ts(AT), limit=15))).unionByName(one("last", T.restore(v)))


def archived_facts(spark, d):
    """Every event as an archive block of its fact, against the log of the events whose content is settled: what would be recorded."""
    e = version_events(spark, d).select("fact_key", X.content_hash(F.col("content")).alias("hash"), "content", F.col("recorded_at").alias("archived"), "event_type")
    return T.ingest_archives(e, e.where("event_type = 'purchase'")).groupBy("fact_key").agg(F.count("*").alias("blocks"), F.min("archived").alias("first"))


_AS_OF = """SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {lo} DESC, recorded_at DESC, version DESC) AS n FROM v{join}
  WHERE {lo} <= {at} AND ({hi} IS NULL OR {hi} > {at}) AND tombstone = 0) WHERE n = 1"""
_W = "WITH " + VERSIONS_SQL + " "


def _as_of(at, axis, cols):
    lo, hi = T._bounds(axis)
    return _AS_OF.format(cols=cols, by="fact_key", lo=lo, hi=hi, join="", at=f"TIMESTAMP '{at}'")


_PRUNE = _W + f"""SELECT fact_key, event_id, version FROM (SELECT *, row_number() OVER (PARTITION BY fact_key ORDER BY version) = 1
  OR row_number() OVER (PARTITION BY fact_key ORDER BY version DESC) <= {KEEP} OR recorded_at >= TIMESTAMP '{CUTOFF}' AS hot FROM v) WHERE """

QUERIES = {f.__name__: f for f in (version_history, current_facts, fact_history, first_seen_order, as_of_valid, as_of_transaction, as_of_many_dates, temporal_stats, facts_with_history, linked_facts, prune_hot, prune_cold, split_tables, appended_log, diff_changed_facts, record_dedup_runs, last_writer_wins, restore_candidates, reconstructed_stores, restored, archived_facts)}
SQL = {
    "version_history": _W + f"SELECT {OUT_SQL} FROM v",
    "current_facts": _W + "SELECT fact_key, store, version, content FROM v WHERE is_current = 1",
    "fact_history": _W + f"SELECT {OUT_SQL} FROM v WHERE fact_key = 7",
    "first_seen_order": "WITH " + VERSION_EVENTS_SQL + " SELECT store, fact_key, min(seq) AS first_seq FROM ev GROUP BY ALL",
    "as_of_valid": _W + _as_of(AT, "valid", "fact_key, version, content, eff_valid_from, valid_to"),
    "as_of_transaction": _W + _as_of(AT, "transaction", "fact_key, version, content, recorded_at, superseded_at"),
    "as_of_many_dates": _W + _AS_OF.format(cols="moment, fact_key, version, content", by="fact_key, moment", lo="eff_valid_from", hi="valid_to", at="moment", join=", (SELECT TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(4 * i AS INTEGER)) AS moment FROM range(1, 8) t(i)) m"),
    "temporal_stats": _W + "SELECT count(*) AS versions, count(DISTINCT fact_key) AS facts, CAST(sum(is_current) AS BIGINT) AS current_facts, CAST(sum(tombstone) AS BIGINT) AS tombstones, min(recorded_at) AS first_recorded, max(recorded_at) AS last_recorded FROM v",
    "facts_with_history": _W + "SELECT count(*) AS facts_with_history FROM (SELECT fact_key FROM v GROUP BY 1 HAVING count(*) > 1)",
    "linked_facts": _W + "SELECT fact_key FROM v GROUP BY 1 HAVING bool_or(op = 'create') AND bool_or(op = 'delete')",
    "prune_hot": _PRUNE + "hot",
    "prune_cold": _PRUNE + "NOT hot",
    "split_tables": (_PRUNE + "hot").replace("SELECT fact_key, event_id, version FROM", "SELECT fact_key, event_id, version, hot FROM").removesuffix(" WHERE hot"),
    "appended_log": "SELECT user_id AS fact_key, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
    "diff_changed_facts": _W + f""", a AS ({_as_of(AT, 'valid', 'fact_key, version, content')}), b AS ({_as_of(LATER, 'valid', 'fact_key, version, content')}),
x AS (SELECT coalesce(a.fact_key, b.fact_key) AS fact_key, a.version AS from_version, b.version AS to_version, coalesce(a.content, '') AS before, coalesce(b.content, '') AS after FROM a FULL JOIN b ON a.fact_key = b.fact_key),
y AS (SELECT *, CASE WHEN before = '' THEN [] ELSE string_split_regex(regexp_replace(before, '([.;|])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS p, CASE WHEN after = '' THEN [] ELSE string_split_regex(regexp_replace(after, '([.;|])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS q FROM x)
SELECT fact_key, from_version, to_version, before, after, trim(before, ' ' || chr(9) || chr(10) || chr(13)) <> trim(after, ' ' || chr(9) || chr(10) || chr(13)) AS changed, CAST(len(list_filter(list_distinct(p), lambda z: NOT list_contains(q, z))) AS INTEGER) AS removed, CAST(len(list_filter(list_distinct(q), lambda z: NOT list_contains(p, z))) AS INTEGER) AS added FROM y""",
    "record_dedup_runs": "WITH " + VERSION_EVENTS_SQL + " SELECT fact_key, event_id, content FROM (SELECT *, lag(content) OVER w AS b, lag(op) OVER w AS o FROM ev WINDOW w AS (PARTITION BY fact_key ORDER BY recorded_at, seq, event_id)) WHERE b IS NULL OR op = 'delete' OR o = 'delete' OR trim(b, ' ' || chr(9) || chr(10) || chr(13)) <> trim(content, ' ' || chr(9) || chr(10) || chr(13))",
    "last_writer_wins": "WITH " + VERSION_EVENTS_SQL + " SELECT event_id, fact_key, CASE WHEN event_id % 3 = 0 THEN content || '!' ELSE content END AS content FROM ev",
    "restore_candidates": _W + f", t AS ({_as_of(AT, 'transaction', 'fact_key, version, content AS restored')}), c AS (SELECT fact_key, content FROM v WHERE is_current = 1) SELECT t.fact_key, version, restored, CASE WHEN content IS NULL THEN 'append' ELSE 'replace' END AS how FROM t LEFT JOIN c ON t.fact_key = c.fact_key WHERE restored IS DISTINCT FROM content AND length(restored) <= 2000",
    "reconstructed_stores": _W + ", o AS (SELECT store, fact_key, min(seq) AS s FROM v GROUP BY ALL) SELECT store, count(*) AS entries, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(CAST(CAST('0x' || substr(sha256(s || ':' || content), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM v JOIN o USING (store, fact_key) WHERE is_current = 1 GROUP BY store",
    "restored": _W + f", m AS ({_as_of(AT, 'valid', 'fact_key, version, content')}), l AS (SELECT * FROM (SELECT fact_key, version, content, row_number() OVER (PARTITION BY fact_key ORDER BY version DESC) AS n FROM v) WHERE n = 1) SELECT 'version' AS selector, fact_key, version, CASE WHEN length(content) > 2000 THEN 'length' END AS refused FROM v WHERE version = 2 UNION ALL SELECT 'moment', fact_key, version, CASE WHEN length(content) > 15 THEN 'length' END FROM m UNION ALL SELECT 'last', fact_key, version, CASE WHEN length(content) > 2000 THEN 'length' END FROM l",
    "archived_facts": "WITH " + VERSION_EVENTS_SQL + ", h AS (SELECT fact_key, event_type, recorded_at, substr(sha256(trim(content, ' ' || chr(9) || chr(10) || chr(13))), 1, 16) AS hash FROM ev), o AS (SELECT fact_key, hash, min(recorded_at) AS archived FROM h GROUP BY ALL) SELECT fact_key, count(*) AS blocks, min(archived) AS first FROM o WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.fact_key = o.fact_key AND h.hash = o.hash AND event_type = 'purchase') GROUP BY 1",
}
