"""Queries of rewriting, health, reconciliation, the harness, and the streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import DUP_NEAR
from ..functions import text as X
from ..functions.shared import shared_dir, stored
from ..operators import audit as A
from ..operators import harness as H
from ..operators import health as L
from ..operators import rewrite as W
from ..sources.files import archive_first
from ..sources.versioned import read_table
from ..streaming import twins
from .bind import TODAY, altered, entries, table
from .text_queries import _BOTH, _E


def _recommended(spark, d, propose=False):
    """All entries with their action, without texts: what is needed of them is stored once."""
    a = A.audit(entries(spark, d), F.lit(TODAY).cast("date"))
    a = stored(A.without_text(W.proposed(a, TODAY) if propose else a), "audit")
    merged = A.losers(a, DUP_NEAR)
    c = A.contradictions(a)
    return A.recommend(a, merged, c.select(F.col("a").alias("ref")).union(c.select("b")))


def _decided(spark, d):
    return W.decide(_recommended(spark, d, True), TODAY)


def _rewritten(spark, d):
    return W.with_text(_decided(spark, d), entries(spark, d))


def rewrite_decisions(spark, d):
    return _decided(spark, d).select("ref", "action", "rewrite", "char_delta")


def rewrite_summary(spark, d):
    return _decided(spark, d).groupBy("rewrite").agg(F.count("*").alias("entries"), F.sum("char_delta").alias("char_delta"), F.count_if(F.col("char_delta") > 0).alias("grown"))


def composed_files(spark, d):
    return W.composed(W.compose(_rewritten(spark, d)))


def rewrite_manifest(spark, d):
    return W.manifest(_rewritten(spark, d)).select("store", "entries", "chars", "source_digest", (F.col("entries_after") <= F.col("entries")).alias("no_more"), "grew")


def rewrite_archives(spark, d):
    return W.archives(_rewritten(spark, d), TODAY, "~/archive").select("ref", "kind", "slug", "hash", "destination")


def archived_bodies(spark, d):
    """All entries as they are read back from an archive that two runs wrote to, the first with the memory store alone: slug, hash and whether the manifest vouches for it."""
    at = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    bodies = entries(spark, d).select(F.concat_ws("-", "store", F.col("ref").cast("string")).alias("slug"), F.col("text").alias("body"), "store")
    archive_first(bodies.where("store = 'memory'"), f"{at}/bodies", f"{at}/manifest")
    told = archive_first(bodies, f"{at}/bodies", f"{at}/manifest")
    return read_table(spark, f"{at}/bodies").select("slug", F.sha2("body", 256).alias("sha256")).join(told, ["slug", "sha256"])


def fixture_controls(spark, d):
    """Tasks whose required documents a run without a budget selects but for very long ones, and pins that a run with none keeps but for each ninth."""
    t = _tasks(spark, d)
    c = H.control(t.select("task", "ref", F.col("ref").cast("string").alias("label"), "required", (F.col("tokens") < 6000).alias("selected")))
    p = H.pin_probe(t.select("task", "ref", F.when(F.col("pinned"), "safety").alias("expected"), F.when(F.col("ref") % 5 != 0, "safety").alias("actual"), (F.col("ref") % 9 != 0).alias("selected")))
    s = H.with_controls(H.task_status(H.recall(t, F.lit(700))).select("task", "mode", "status"), c, p)
    return s.join(c.select("task", F.array_join("missing", ",").alias("missing")), "task").join(p.select("task", F.size("dropped").alias("dropped"), F.size("misclassed").alias("misclassed")), "task", "left")


def drift_kinds(spark, d):
    """Each source's documents as a store, rebuilt from other copies: as they are, with other white space, in another order, or with another text."""
    live = table(spark, d, "documents").select(F.col("source").alias("store"), F.col("doc_id").alias("at"), "text")
    k = F.pmod(F.length("store") + F.ascii(F.right("store", F.lit(1))), F.lit(4))
    rebuilt = live.withColumn("text", F.when(k == 1, F.concat("text", F.lit("  "))).when(k == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("at", F.when(k == 2, -F.col("at")).otherwise(F.col("at")))
    return L.store_drift(live, rebuilt)


def capacity_flags(spark, d):
    """Each source's documents as a store of 100,000 characters."""
    files = table(spark, d, "documents").groupBy(F.col("source").alias("store")).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("entries")).withColumn("char_limit", F.lit(100000))
    return L.capacity(files).select("store", "chars", "entries", F.floor(F.col("percent") * 10 + 0.5).cast("long").alias("tenths"), "status", "pressure")


def health_rollup(spark, d):
    flags = capacity_flags(spark, d)
    checks = flags.select(F.col("store").alias("check"), "status")
    return L.rollup(checks).select("status", F.array_join("alerts", ",").alias("alerts"))


def _sides(spark, d):
    """All entries as live files and an altered copy of all of them as the store's current facts, by key: the first entry of each."""
    side = lambda e: e.groupBy(X.fact_key(F.col("text")).alias("key")).agg(F.min_by(X.content_hash(F.col("text")), "ref").alias("hash"))
    return side(entries(spark, d)), side(altered(spark, d))


def reconcile_full_outer(spark, d):
    return L.reconcile(*_sides(spark, d))


def bag_drift(spark, d):
    """All entries against an altered copy of all of them, as bags."""
    live, rebuilt = (e.select(X.content_hash(F.col("text")).alias("text")) for e in (entries(spark, d), altered(spark, d)))
    return L.drift(live, rebuilt).groupBy("side").agg(F.count("*").alias("entries"), F.min("text").alias("first"))


def set_operations(spark, d):
    """Union, difference and intersection of two sets of keys."""
    a, b = (x.select("key") for x in _sides(spark, d))
    one = lambda df, name: df.agg(F.count("*").alias("keys"), F.min("key").alias("first")).withColumn("set", F.lit(name))
    return one(a.union(b).distinct(), "union").unionByName(one(a.subtract(b), "difference")).unionByName(one(a.intersect(b), "intersection"))


def _tasks(spark, d):
    """Documents as entries of twenty tasks: gold by label, selected by a budget of the shortest."""
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("ref"), (F.col("quality") == 1).alias("required"), (F.col("toxic") == 1).alias("pinned"))
    e = table(spark, d, "documents").select(F.col("doc_id").alias("ref"), X.entry_weight(F.col("text")).alias("tokens")).join(gold, "ref")
    return e.select((F.col("ref") % 20).alias("task"), F.when(F.col("ref") % 2 == 0, "lexical").otherwise("static").alias("mode"), "ref", "tokens", "required", ((F.col("tokens") < 900) | (F.col("pinned") & (F.col("ref") % 3 != 0))).alias("selected"), F.col("pinned"))


def harness_tasks(spark, d):
    return H.task_status(H.recall(_tasks(spark, d), F.lit(700)))


def harness_modes(spark, d):
    m = H.mode_rollup(H.task_status(H.recall(_tasks(spark, d), F.lit(700))))
    return m.select("mode", F.floor(F.col("savings") * 10000 + 0.5).cast("long").alias("savings"), F.floor(F.col("recall") * 10000 + 0.5).cast("long").alias("recall"), "pass", "warn", "fail")


def graded_tasks(spark, d):
    """Made-up findings over the benchmark: which labels were kept follows from the item's number."""
    i = F.col("item_id")
    labels = lambda k: F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda x: F.when((i + x) % k != 0, F.concat(F.lit("r"), x.cast("string")))), lambda x: x.isNotNull())
    v = table(spark, d, "benchmark").select(
        i.alias("task"), labels(99).alias("required"), F.array(F.lit("p1"), F.lit("p2")).alias("pins"), labels(3).alias("preserved"), F.when(i % 5 == 0, F.array(F.lit("r2"))).otherwise(F.array().cast("array<string>")).alias("missing"),
        F.when(i % 2 == 0, F.array(F.lit("p1"), F.lit("p2"))).otherwise(F.array(F.lit("p1"))).alias("honored"), F.when(i % 11 == 0, F.array(F.lit("p2"))).otherwise(F.array().cast("array<string>")).alias("violated"),
        F.when(i % 4 == 0, "equivalent").when(i % 4 == 1, "degraded").otherwise("odd").alias("equivalence"), (i % 13 == 0).alias("unreachable"), (i % 17 == 5).alias("parse_error"),
    )
    return H.graded(v).select("task", F.array_join("lost", ",").alias("lost"), F.array_join("unconfirmed", ",").alias("unconfirmed"), "status")


def _stream(spark, d):
    return twins.event_stream(spark, f"{d}/events.parquet")


def streaming_versions(spark, d):
    v = twins.drain(twins.closed_versions(_stream(spark, d)), shared_dir(spark))
    return v.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("recorded_at", "superseded_at")})


def streaming_once(spark, d):
    return twins.drain(twins.once(_stream(spark, d)), shared_dir(spark)).select("event_id", "fact_key")


def windowed_counts(spark, d):
    return twins.drain(twins.windowed(_stream(spark, d)), shared_dir(spark)).withColumn("from", F.col("from").cast("timestamp_ntz"))


def sessionized(spark, d):
    s = twins.drain(twins.sessionized(_stream(spark, d)), shared_dir(spark))
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("from", "to")})


QUERIES = {f.__name__: f for f in (rewrite_decisions, rewrite_summary, composed_files, rewrite_manifest, rewrite_archives, archived_bodies, fixture_controls, drift_kinds, capacity_flags, health_rollup, reconcile_full_outer, bag_drift, set_operations, harness_tasks, harness_modes, graded_tasks, streaming_versions, streaming_once, windowed_counts, sessionized)}

_CAP = """WITH f AS (SELECT source AS store, sum(length(text)) AS chars, count(*) AS entries FROM documents GROUP BY 1), p AS (SELECT *, round(100 * chars / 100000e0, 1) AS pct FROM f),
c AS (SELECT store, chars, entries, pct, CASE WHEN pct >= 90 OR entries > 35 THEN 'critical' WHEN pct >= 80 OR entries > 25 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN entries > 35 THEN 'critical' WHEN entries > 25 THEN 'warning' ELSE 'ok' END AS pressure FROM p)"""
_SIDES = _BOTH + ", a AS (SELECT fact_key AS k, arg_min(hash, ref) AS h FROM keys GROUP BY 1), b AS (SELECT fact_key AS k, arg_min(hash, ref) AS h FROM others GROUP BY 1)"
_TASKS = """WITH t AS (SELECT d.doc_id % 20 AS task, CASE WHEN d.doc_id % 2 = 0 THEN 'lexical' ELSE 'static' END AS mode, (length(text) + 3) // 4 + 1 AS tok, quality = 1 AS req, toxic = 1 AS pin, d.doc_id AS ref FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
s AS (SELECT *, tok < 900 OR (pin AND ref % 3 <> 0) AS sel FROM t),
r AS (SELECT task, mode, count(*) FILTER (req) AS required, count(*) FILTER (req AND sel) AS kept, count(*) FILTER (sel) AS selected, count(*) FILTER (req AND NOT sel AND tok <= 700) AS droppable, count(*) FILTER (req AND NOT sel AND tok > 700) AS unfittable,
  count(*) FILTER (pin AND NOT sel) AS lost_pins, CAST(sum(tok) AS BIGINT) AS full_tokens, CAST(coalesce(sum(tok) FILTER (sel), 0) AS BIGINT) AS tokens FROM s GROUP BY ALL),
h AS (SELECT *, CASE WHEN required = 0 THEN 1e0 ELSE CAST(kept AS DOUBLE) / required END AS share FROM r),
st AS (SELECT *, CASE WHEN lost_pins > 0 THEN 'FAIL' WHEN droppable > 0 AND share < 0.5e0 THEN 'FAIL' WHEN droppable > 0 OR unfittable > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM h)"""
SQL = {
    "archived_bodies": _E + " SELECT store || '-' || ref AS slug, sha256(text) AS sha256, true AS matches FROM e",
    "capacity_flags": _CAP + " SELECT store, chars, entries, CAST(floor(pct * 10 + 0.5e0) AS BIGINT) AS tenths, status, pressure FROM c",
    "health_rollup": _CAP + " SELECT CASE WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'ok' END AS status, coalesce(string_agg(store, ',' ORDER BY store) FILTER (status <> 'ok'), '') AS alerts FROM c",
    "reconcile_full_outer": _SIDES + " SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'updated' END AS state FROM a FULL JOIN b ON a.k = b.k",
    "bag_drift": _BOTH + ", l AS (SELECT hash FROM keys), r AS (SELECT hash FROM others) SELECT 'live' AS side, count(*) AS entries, min(hash) AS first FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT 'rebuilt', count(*), min(hash) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)",
    "set_operations": _SIDES + " SELECT 'union' AS set, count(*) AS keys, min(k) AS first FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'difference', count(*), min(k) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersection', count(*), min(k) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)",
    "harness_tasks": _TASKS + " SELECT task, mode, required, kept, selected, droppable, unfittable, lost_pins, full_tokens, tokens, status FROM st",
    "harness_modes": _TASKS + " SELECT mode, CAST(floor((1 - CAST(sum(tokens) AS DOUBLE) / sum(full_tokens)) * 10000 + 0.5e0) AS BIGINT) AS savings, CAST(floor(avg(share) * 10000 + 0.5e0) AS BIGINT) AS recall, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'FAIL') AS fail FROM st GROUP BY mode",
    "rewrite_manifest": _E + " SELECT store, count(*) AS entries, CAST(sum(length(text)) + (count(*) - 1) * 3 AS BIGINT) AS chars, CAST(sum(CAST(CAST('0x' || substr(sha256(ref || ':' || text), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS source_digest, true AS no_more, false AS grew FROM e GROUP BY store",
    "fixture_controls": _TASKS + """, c AS (SELECT task, array_to_string(list_sort(list(CAST(ref AS VARCHAR)) FILTER (req AND tok >= 6000)), ',') AS missing FROM s GROUP BY 1),
p AS (SELECT task, CAST(count(*) FILTER (ref % 9 = 0) AS INTEGER) AS dropped, CAST(count(*) FILTER (ref % 9 <> 0 AND ref % 5 = 0) AS INTEGER) AS misclassed FROM s WHERE pin GROUP BY 1)
SELECT st.task, mode, CASE WHEN coalesce(missing, '') <> '' OR coalesce(dropped, 0) > 0 THEN 'FAIL' WHEN coalesce(misclassed, 0) > 0 AND status = 'PASS' THEN 'WARN' ELSE status END AS status, coalesce(missing, '') AS missing, dropped, misclassed FROM st JOIN c USING (task) LEFT JOIN p USING (task)""",
    "drift_kinds": "SELECT source AS store, CASE (length(source) + ascii(right(source, 1))) % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'whitespace' WHEN 2 THEN CASE WHEN bool_and(doc_id = 0) THEN 'exact' ELSE 'order' END ELSE 'content' END AS drift FROM documents GROUP BY source",
    "graded_tasks": """WITH i AS (SELECT item_id AS task, list_filter(['r1', 'r2', 'r3', 'r4'], lambda x: (item_id + CAST(substr(x, 2) AS BIGINT)) % 99 <> 0) AS required, list_filter(['r1', 'r2', 'r3', 'r4'], lambda x: (item_id + CAST(substr(x, 2) AS BIGINT)) % 3 <> 0 AND NOT (item_id % 5 = 0 AND x = 'r2')) AS kept,
  list_filter(['p1', 'p2'], lambda x: x = 'p2' AND item_id % 2 <> 0 AND item_id % 11 <> 0) AS unsure, item_id % 11 = 0 AS broken, CASE WHEN item_id % 4 = 0 THEN 'equivalent' ELSE 'degraded' END AS equal, item_id % 13 = 0 AS unreachable, item_id % 17 = 5 AS bad FROM benchmark),
l AS (SELECT *, list_filter(required, lambda x: NOT list_contains(kept, x)) AS lost FROM i)
SELECT task, array_to_string(lost, ',') AS lost, array_to_string(unsure, ',') AS unconfirmed, CASE WHEN unreachable THEN 'BLOCKED' WHEN bad THEN 'ERROR' WHEN broken THEN 'FAIL' WHEN len(required) > 0 AND CAST(len(required) - len(lost) AS DOUBLE) / len(required) < 0.5e0 THEN 'FAIL' WHEN len(lost) > 0 OR len(unsure) > 0 OR equal = 'degraded' THEN 'WARN' ELSE 'PASS' END AS status FROM l""",
    "windowed_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS \"from\", event_type AS kind, count(*) AS events FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL",
    "sessionized": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id AS fact_key, min(ts) AS "from", max(ts) + INTERVAL 2 HOUR AS "to", count(*) AS events FROM n GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "streaming_once": "SELECT event_id, user_id AS fact_key FROM events",
    "streaming_versions": "SELECT * FROM (SELECT user_id AS fact_key, CAST(row_number() OVER w AS INTEGER) AS version, event_id, concat_ws(':', event_type, props) AS content, ts AS recorded_at, lead(ts) OVER w AS superseded_at, lead(event_id) OVER w AS superseded_by FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE superseded_by IS NOT NULL",
}
