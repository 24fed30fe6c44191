"""Queries of the search map, shadow runs, lookups that feed projection, policies and the smaller text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.shared import stored
from ..operators import audit as A
from ..operators import policy as O
from ..operators import projection as J
from ..operators import searchmap as M
from ..operators import sessions as S
from ..operators import shadow as W
from ..operators import telemetry as T
from .bind import TODAY, altered, entries, quoted, table
from .recall_queries import _LEX, _lexical
from .report_queries import _recommended
from .telemetry_queries import _LF, _M, _messages, _turns
from .telemetry_queries import TODAY as SEEN
from .text_queries import _ACTION, _BOTH, _DATES, _E, _STRIP, _bag, _says, _stop, keyed

#: The stores as they are found, by name: present, status, fresh, daemon.
STORES = (("hot_memory", True, "ok", False, None), ("user_memory", True, "ok", True, None), ("notes_index", True, "unreadable", True, None), ("temporal", True, "ok", False, None), ("semantic", True, "ok", None, "up"), ("spine", True, "locked", None, None))
#: Which of them backs a lane's store.
BACKING = {"semantic_memories": "semantic", "semantic_sessions": "semantic", "temporal": "temporal", "notes_index": "notes_index", "spine": "spine"}
PLACES = ("hot_memory", "user_memory", "notes_index")


def _values(rows):
    show = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else quoted(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def _stores(spark):
    return spark.sql("SELECT store, present, status, CAST(fresh AS BOOLEAN) AS fresh, CAST(daemon AS STRING) AS daemon FROM " + _values(STORES) + " AS s(store, present, status, fresh, daemon)")


def _questions(spark, d):
    """Each user turn as a question."""
    return _messages(spark, d).where("role = 'user'").select((F.col("session_id") * 1000 + F.col("ord")).alias("query_id"), F.col("content").alias("question"))


def _topics(spark, d):
    """Benchmark items as topics of the lanes in turn."""
    i = F.col("item_id")
    at = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (i % len(xs)).cast("int"))
    lanes = [lane for lane, _ in M.LANES]
    return table(spark, d, "benchmark").select(at(lanes).alias("lane"), F.concat(F.lit("topic-"), i.cast("string")).alias("key"), at(PLACES).alias("where"), at(PLACES).alias("source"), X.query_terms(F.col("text")).alias("terms"))


def topic_matches(spark, d):
    m = M.topic_matches(_questions(spark, d), _topics(spark, d))
    return m.select("query_id", "lane", "key", F.array_join("matched", " ").alias("matched"), F.round(F.col("match") * 1000).cast("long").alias("match"))


def _ranked(spark, d):
    q = stored(_questions(spark, d), "questions")
    daemon = F.when(F.col("store") == "semantic", F.coalesce("daemon", F.lit("down")))
    states = _stores(spark).select("store", M.availability(F.col("present"), F.col("status"), F.col("fresh"), daemon).alias("availability"))
    backing = spark.sql("SELECT * FROM " + _values(BACKING.items()) + " AS b(lane_store, store)")
    feedback = T.lane_feedback(_turns(spark, d).withColumn("lane", F.when(F.col("lane") == "click", "memory-entry").when(F.col("lane") == "view", "temporal").otherwise(F.col("lane"))), F.lit(SEEN).cast("date"))
    return M.rank(q, M.topic_matches(q, _topics(spark, d)), backing.join(states, "store").select(F.col("lane_store").alias("store"), "availability"), feedback)


def search_lanes(spark, d):
    return _ranked(spark, d).select("query_id", "lane", "intent", "availability", F.round(F.col("topic") * 1000).cast("long").alias("topic"), F.round(F.col("score") * 1000).cast("long").alias("score"), "rank")


def route_packets(spark, d):
    p = M.route_packets(_ranked(spark, d))
    return p.select("query_id", "recommended_lane", "memory_where", F.size("query_terms").alias("terms"), F.array_join("matched_keys", ",").alias("matched_keys"), "matched")


def _store_states(spark, d):
    """Each store by the table that stands for it: there if it has rows, sound if what it needs is in all of them, fresh if its last date is near."""
    near = F.date_sub(F.lit(TODAY).cast("date"), 60)
    yes = F.lit(True)
    of = {
        "hot_memory": ("documents", F.bool_and(F.col("text").isNotNull()), yes), "user_memory": ("labels", F.bool_and(F.col("toxic") == 0), yes), "temporal": ("events", F.bool_and(F.col("user_id").isNotNull()), F.max("ts").cast("date") >= near),
        "notes_index": ("pages", F.bool_and(F.contains("url", F.lit("://"))), yes), "master_index": ("benchmark", F.bool_and(F.length("text") > 40), yes),
        "shadow_report": ("conversations", F.bool_and(F.col("role").isin("user", "assistant")), yes), "semantic": ("embeddings", F.bool_and(F.size("embedding") == 64), yes),
        "spine": ("orders", F.bool_and(F.col("o_totalprice") > 0), F.max("o_orderdate").cast("date") >= near),
    }
    out = None
    for name, (source, sound, fresh) in of.items():
        one = table(spark, d, source).agg(F.lit(name).alias("store"), (F.count("*") > 0).alias("present"), F.when(F.coalesce(sound, F.lit(False)), "ok").otherwise("degraded").alias("status"), fresh.alias("fresh"))
        one = one.select("store", "present", "status", "fresh", F.when((F.lit(name) == "semantic") & (F.col("status") == "ok"), "up").alias("daemon"))
        out = one if out is None else out.unionByName(one)
    return out


def store_doctor(spark, d):
    out = M.doctor(_store_states(spark, d))
    return out.select("status", F.array_join("failures", "; ").alias("failures"), F.array_join("warnings", "; ").alias("warnings"))


def _answers(spark, d):
    """Benchmark items as answers, each third naming an entry by its label."""
    i = F.col("item_id")
    return table(spark, d, "benchmark").select(i.alias("answer_id"), F.when(i % 3 == 0, F.concat("text", F.lit(" See Memory.md#"), i.cast("string"), F.lit(" at ~/notes/plan.md"))).otherwise(F.col("text")).alias("answer"))


def answer_usage(spark, d):
    e = entries(spark, d).select("ref", F.concat(F.col("store"), F.lit(".md#"), F.col("ref").cast("string")).alias("label"), "text", (F.col("ref") % 4 != 0).alias("selected"))
    return W.usage(_answers(spark, d), e).select("answer_id", "ref", "selected", F.round(F.col("overlap") * 10000).cast("long").alias("overlap"), F.array_join("path_hits", ",").alias("path_hits"), "reason")


def shadow_events(spark, d):
    """Profiles of fifty entries whose shorter ones are projected, with made-up usage of each second one."""
    e = entries(spark, d).select(F.floor(F.col("ref") / 50).alias("grp"), "ref", "text", X.entry_weight(F.col("text")).alias("tokens"), (F.length("text") < 1500).alias("selected"), F.when(F.col("ref") % 16 == 11, "safety").when(F.col("ref") % 16 == 3, "operational").otherwise("none").alias("pin"))
    counts = e.where("grp % 2 = 0").groupBy("grp").agg(F.count("*").alias("used"), F.count_if("selected").alias("used_selected"), F.count_if(~F.col("selected")).alias("used_missing"))
    out = W.events(e, counts, 20000, F.lit(TODAY))
    return out.select("grp", "full_tokens", "tokens", "selected_count", "skipped_count", "skipped_pins", "safety_drops", "full_digest", "digest", F.floor(F.col("savings") * 10 + 0.5).cast("long").alias("savings"), "over_budget", "used_missing")


def recency_sources(spark, d):
    """When entries are of: by the current facts that an altered copy of all makes, else by their text."""
    e = keyed(entries(spark, d))
    k = keyed(altered(spark, d))
    facts = k.select("store", "hash", F.col("key").alias("fact_key"), F.when(F.col("ref") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("ref") % 60).cast("int"))).alias("day"))
    out = J.dated(e, facts, X.latest_date(F.col("text")))
    return out.select("ref", F.col("day").cast("string").alias("day"), F.col("day_source").alias("source"), F.round(J.recency(F.col("day"), F.lit(TODAY).cast("date")) * 1e6).cast("long").alias("recency"))


def relevance_lookup(spark, d):
    """The twenty best lexical hits of each benchmark item, known by content for two thirds of them and by number for the others, looked up from all entries."""
    e = entries(spark, d).select("ref", X.content_hash(F.col("text")).alias("hash"))
    hits = _lexical(spark, d).select("query_id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("ref"), F.when(F.col("id") % 3 != 0, F.col("hash")).alias("hash"), "score")
    return J.relevant(e, hits).select("query_id", "ref", F.round(F.col("relevance") * 1e4).cast("long").alias("relevance"), "found_by")


def more_bags(spark, d):
    """Sizes of the bags of the search map, the harness and shadow runs, and of the audit's without an owner's names."""
    t = F.col("text")
    return entries(spark, d).select("ref", F.size(F.array_distinct(X.query_terms(t))).alias("search"), F.size(X.harness_tokens(t)).alias("harness"), F.size(X.shadow_tokens(t)).alias("shadow"), F.size(X.without_owner(X.subject_tokens(t), "/home/Stores", "dark mode")).alias("owned"))


def bag_cosines(spark, d):
    """Each entry against the entry as altered."""
    a = altered(spark, d).select("ref", X.gate_tokens(F.col("text")).alias("y"))
    return entries(spark, d).select("ref", X.gate_tokens(F.col("text")).alias("x")).join(a, "ref").select("ref", F.floor(X.bag_cosine(F.col("x"), F.col("y")) * 10000 + 0.5).cast("long").alias("cosine"))


def audit_keys(spark, d):
    return entries(spark, d).select("ref", X.audit_key(F.col("text")).alias("audit_key"))


def shown_sizes(spark, d):
    size = F.col("n_chars") * F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", X.human_bytes(size).alias("size"), X.shown_path(F.concat_ws("/", F.lit("/home"), "source", "lang"), "/home/src1").alias("path"))


def parsed_dates(spark, d):
    """Dates, instants with and without a zone, epoch seconds and what can't be read, from each event's number."""
    from ..operators.temporal import parse_dt

    i = F.col("event_id")
    made = F.array(
        F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), (i + 1_700_000_000).cast("string"), F.lit(" "), F.lit("soon"),
    )
    return table(spark, d, "events").select("event_id", parse_dt(F.get(made, (i % 7).cast("int"))).alias("at"))


def store_summaries(spark, d):
    limits = spark.sql("SELECT * FROM VALUES ('memory', 15000), ('user', 6000) AS l(store, char_limit)")
    out = A.store_summary(_recommended(spark, d), limits)
    tenths = lambda c: F.floor(F.col(c) * 10 + 0.5).cast("long").alias(c)
    return out.select("store", "entries", "actionable", "broken", "chars", "recoverable", tenths("percent"), tenths("percent_after"))


def top_shrink(spark, d):
    return A.top_shrink(_recommended(spark, d))


def candidate_turns(spark, d):
    """Turns of conversations that started late enough, of all sources but two, the last turn of each third one no longer active."""
    c = table(spark, d, "conversations")
    at = lambda n: F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (n % 700).cast("int"))
    source = F.element_at(F.array(*[F.lit(x) for x in ("Telegram", "cli", "cron", "subagent", None)]), (F.col("conv_id") % 5 + 1).cast("int"))
    sessions = c.groupBy(F.col("conv_id")).agg(F.count("*").alias("n")).select(F.col("conv_id").alias("id"), source.alias("source"), at(F.col("conv_id")).alias("started_at"))
    messages = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("turn").alias("timestamp"), "role", F.col("text").alias("content"), F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), 0).otherwise(1).alias("active"))
    out = S.candidate_sessions(sessions, messages, F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"), exclude=["cron", "subagent"])
    return out.groupBy("session_id", "source").agg(F.count("*").alias("turns"), F.sum(F.length("content")).alias("chars"), F.max("ord").alias("last"))


def judged_policies(spark, d):
    """A policy a benchmark item: its settings follow from the number."""
    i = F.col("item_id")
    flag = lambda k: F.when(i % 11 != k, i % k == 0)
    p = table(spark, d, "benchmark").select(
        i.alias("policy"), F.when(i % 7 == 0, "other").otherwise("retention/1").alias("schema"), F.when(i % 4 != 0, (i % 12 - 1).cast("int")).alias("retention_days"), F.when(i % 5 != 0, (i % 3 - 1).cast("int")).alias("protect_recent_days"),
        *[flag(k).alias(c) for k, c in zip((2, 3, 4, 5, 6, 7, 8), O.FLAGS, strict=True)],
    )
    return O.judged(p, "retention/1").select("policy", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "noop")


QUERIES = {f.__name__: f for f in (topic_matches, search_lanes, route_packets, store_doctor, answer_usage, shadow_events, recency_sources, relevance_lookup, more_bags, bag_cosines, audit_keys, shown_sizes, parsed_dates, store_summaries, top_shrink, candidate_turns, judged_policies)}

_LANES = ", ".join(f"('{lane}', {i}, {quoted(store) if store else 'NULL'})" for i, (lane, store) in enumerate(M.LANES))
_AT = lambda xs: "[" + ", ".join(map(quoted, xs)) + f"][item_id % {len(xs)} + 1]"
_QT = lambda c: f"list_distinct({_bag(c, '[a-z][a-z0-9_]{2,}', P.QUERY_STOP)})"
_TERMS = f""", qu AS (SELECT session_id * 1000 + ord AS query_id, content AS question, {_QT('content')} AS terms FROM m WHERE role = 'user'),
tp AS (SELECT {_AT([x for x, _ in M.LANES])} AS lane, 'topic-' || item_id AS key, {_AT(PLACES)} AS source, {_QT('text')} AS terms FROM benchmark),
tm AS (SELECT query_id, lane, key, source, list_sort(list_intersect(qu.terms, tp.terms)) AS matched, round(len(list_intersect(qu.terms, tp.terms)) / CAST(len(qu.terms) AS DOUBLE), 3) AS match FROM qu, tp WHERE list_has_any(qu.terms, tp.terms))"""
_QM = _LF.replace("event_type AS lane", "CASE event_type WHEN 'click' THEN 'memory-entry' WHEN 'view' THEN 'temporal' ELSE event_type END AS lane")
_SAID = _M.removeprefix("WITH ")
_WANT = "CASE lane " + " ".join(f"WHEN '{lane}' THEN {_says(p, 'ascii')}" for lane, p in P.INTENTS.items()) + " END"
_RANKED = _QM + ", " + _SAID + _TERMS + f""", sl AS (SELECT * FROM (VALUES {_LANES}) t(lane, lane_order, store)), st AS (SELECT * FROM (VALUES ('semantic_memories', 'ok'), ('semantic_sessions', 'ok'), ('temporal', 'stale'), ('notes_index', 'degraded'), ('spine', 'degraded')) t(store, state)),
bt AS (SELECT query_id, lane, max(match) AS topic, list(key ORDER BY match DESC, key)[1:3] AS keys, list(source ORDER BY match DESC, key)[1:3] AS sources FROM tm GROUP BY ALL),
rk0 AS (SELECT qu.query_id, qu.terms, sl.lane, lane_order, regexp_replace(question, '[À-ɏ]', 'q', 'g') AS ascii, coalesce(bt.topic, 0e0) AS topic, keys, sources, CASE WHEN sl.store IS NULL THEN 'n/a' ELSE coalesce(state, 'missing') END AS availability, coalesce(f.adjustment, 0e0) AS adjustment
  FROM qu CROSS JOIN sl LEFT JOIN bt ON bt.query_id = qu.query_id AND bt.lane = sl.lane LEFT JOIN st ON st.store = sl.store LEFT JOIN f ON f.lane = sl.lane),
rk1 AS (SELECT *, {_WANT} AS intent FROM rk0), rk2 AS (SELECT *, round(2 * CASE WHEN intent THEN 1e0 ELSE 0e0 END + 3 * topic, 3) AS signal, round(2 * CASE WHEN intent THEN 1e0 ELSE 0e0 END + 3 * topic + CASE availability WHEN 'ok' THEN 1e0 WHEN 'stale' THEN 0.4e0 WHEN 'degraded' THEN 0.2e0 WHEN 'n/a' THEN 0.5e0 ELSE 0e0 END + adjustment, 3) AS score FROM rk1),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lane_order) AS rank FROM rk2)"""
_ST = "list_distinct(list_transform(regexp_extract_all({}, '(?i)[a-z0-9_./@+-]{{3,}}'), lambda x: lower(x)))"
_GB2 = lambda c: f"list_distinct(list_concat({_bag(c, '[a-z][a-z0-9]{3,}', P.GATE_STOP)}, list_transform(regexp_extract_all({c}, '~?/[\\w./-]+'), lambda x: lower(x))))"
_POLICY_FLAGS = ", ".join(f"CASE WHEN item_id % 11 <> {k} THEN item_id % {k} = 0 END AS {c}" for k, c in zip((2, 3, 4, 5, 6, 7, 8), O.FLAGS, strict=True))

SQL = {
    "topic_matches": "WITH " + _SAID + _TERMS + " SELECT query_id, lane, key, array_to_string(matched, ' ') AS matched, CAST(round(match * 1000) AS BIGINT) AS match FROM tm",
    "search_lanes": _RANKED + " SELECT query_id, lane, intent, availability, CAST(round(topic * 1000) AS BIGINT) AS topic, CAST(round(score * 1000) AS BIGINT) AS score, rank FROM rk",
    "route_packets": _RANKED + """, sp AS (SELECT query_id, bool_or(signal > 1e-9) AS matched FROM rk GROUP BY 1) SELECT query_id, lane AS recommended_lane, CASE WHEN lane = 'memory-entry' AND len(list_distinct(list_filter(sources, lambda x: x <> 'notes_index'))) = 1 THEN CASE WHEN list_contains(sources, 'user_memory') THEN 'user' ELSE 'memory' END END AS memory_where,
  len(terms) AS terms, coalesce(array_to_string(keys, ','), '') AS matched_keys, matched FROM rk JOIN sp USING (query_id) WHERE rank = 1""",
    "store_doctor": f"""WITH s(store, present, sound, fresh) AS (SELECT 'hot_memory', count(*) > 0, bool_and(text IS NOT NULL), true FROM documents UNION ALL SELECT 'user_memory', count(*) > 0, bool_and(toxic = 0), true FROM labels
UNION ALL SELECT 'temporal', count(*) > 0, bool_and(user_id IS NOT NULL), CAST(max(ts) AS DATE) >= DATE '{TODAY}' - 60 FROM events UNION ALL SELECT 'notes_index', count(*) > 0, bool_and(contains(url, '://')), true FROM pages
UNION ALL SELECT 'master_index', count(*) > 0, bool_and(length(text) > 40), true FROM benchmark UNION ALL SELECT 'shadow_report', count(*) > 0, bool_and(role IN ('user', 'assistant')), true FROM conversations
UNION ALL SELECT 'semantic', count(*) > 0, bool_and(len(embedding) = 64), true FROM embeddings UNION ALL SELECT 'spine', count(*) > 0, bool_and(o_totalprice > 0), CAST(max(o_orderdate) AS DATE) >= DATE '{TODAY}' - 60 FROM orders),
w AS (SELECT CASE WHEN store = 'hot_memory' THEN CASE WHEN present AND sound AND NOT fresh THEN 'hot_memory stale' END WHEN store = 'semantic' THEN CASE WHEN NOT coalesce(sound, false) THEN 'semantic daemon down' END
  WHEN store = 'spine' THEN CASE WHEN present AND NOT coalesce(sound, false) THEN 'spine unreadable' END WHEN NOT present THEN store || ' missing' WHEN NOT coalesce(sound, false) THEN store || ' degraded' WHEN NOT fresh THEN store || ' stale' END AS w,
  CASE WHEN store = 'hot_memory' THEN CASE WHEN NOT present THEN 'hot_memory missing' WHEN NOT coalesce(sound, false) THEN 'hot_memory unreadable' END END AS f FROM s)
SELECT CASE WHEN count(f) > 0 THEN 'FAIL' WHEN count(w) > 0 THEN 'WARN' ELSE 'PASS' END AS status, coalesce(string_agg(f, '; ' ORDER BY f), '') AS failures, coalesce(string_agg(w, '; ' ORDER BY w), '') AS warnings FROM w""",
    "answer_usage": _E + f""", an AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text || ' See Memory.md#' || item_id || ' at ~/notes/plan.md' ELSE text END AS answer FROM benchmark), x AS (SELECT item_id, lower(answer) AS low, {_ST.format('answer')} AS t FROM an), y AS (SELECT ref, store || '.md#' || ref AS label, {_ST.format('text')} AS t FROM e),
p AS (SELECT item_id, ref, list_contains(regexp_extract_all(low, '[\\w.-]+#\\d+'), label) AS named, list_intersect(x.t, y.t) AS com, len(x.t) AS nx, len(y.t) AS ny FROM x, y),
q AS (SELECT *, CAST(len(com) AS DOUBLE) / (nx + ny - len(com)) AS o, list_sort(list_filter(com, lambda w: contains(w, '/') OR starts_with(w, '~')))[1:5] AS h FROM p)
SELECT item_id AS answer_id, ref, ref % 4 <> 0 AS selected, CAST(round(round(o, 4) * 10000) AS BIGINT) AS overlap, array_to_string(h, ',') AS path_hits, CASE WHEN named OR len(h) > 0 THEN 'path/label' ELSE 'token-overlap' END AS reason FROM q WHERE o >= 0.16e0 OR named OR len(h) > 0""",
    "shadow_events": _E + """, x AS (SELECT ref // 50 AS grp, ref, text, (length(text) + 3) // 4 + 1 AS tok, length(text) < 1500 AS sel, CASE ref % 16 WHEN 11 THEN 'safety' WHEN 3 THEN 'operational' ELSE 'none' END AS pin, CAST(CAST('0x' || substr(sha256(ref || ':' || text), 1, 15) AS BIGINT) AS HUGEINT) AS h FROM e),
g AS (SELECT grp, CAST(sum(tok) AS BIGINT) AS full_tokens, CAST(coalesce(sum(tok) FILTER (sel), 0) AS BIGINT) AS tokens, count(*) FILTER (sel) AS selected_count, count(*) FILTER (NOT sel) AS skipped_count, count(*) FILTER (NOT sel AND pin <> 'none') AS skipped_pins, count(*) FILTER (NOT sel AND pin = 'safety') AS safety_drops, CAST(sum(h) AS VARCHAR) AS full_digest, CAST(coalesce(sum(h) FILTER (sel), 0) AS VARCHAR) AS digest FROM x GROUP BY 1)
SELECT *, CAST(floor(round(100 * (1 - CAST(tokens AS DOUBLE) / full_tokens), 1) * 10 + 0.5e0) AS BIGINT) AS savings, tokens > 20000 AS over_budget, CASE WHEN grp % 2 = 0 THEN skipped_count END AS used_missing FROM g""",
    "recency_sources": _BOTH + f""", kd AS (SELECT store, hash, fact_key, DATE '2024-01-01' + CAST(ref % 60 AS INTEGER) AS day FROM others WHERE ref % 7 <> 0), bh AS (SELECT store, hash, max(day) AS day FROM kd GROUP BY ALL), bk AS (SELECT store, fact_key, max(day) AS day FROM kd GROUP BY ALL),
tx AS (SELECT ref, list_max({_DATES}) AS day FROM (SELECT ref, regexp_replace(text, '[À-ɏ]', 'q', 'g') AS ascii FROM e)),
r AS (SELECT k.ref, coalesce(bh.day, bk.day, CAST(tx.day AS DATE)) AS day, CASE WHEN bh.day IS NOT NULL THEN 'temporal:hash' WHEN bk.day IS NOT NULL THEN 'temporal:key' WHEN tx.day IS NOT NULL THEN 'text-date' ELSE 'neutral-default' END AS source
  FROM keys k LEFT JOIN bh ON bh.store = k.store AND bh.hash = k.hash LEFT JOIN bk ON bk.store = k.store AND bk.fact_key = k.fact_key JOIN tx ON tx.ref = k.ref)
SELECT ref, CAST(day AS VARCHAR) AS day, source, CAST(round(CASE WHEN day IS NULL THEN 0.5e0 ELSE least(1e0, pow(0.5e0, greatest(date_diff('day', day, DATE '{TODAY}'), 0) / 30e0)) END * 1e6) AS BIGINT) AS recency FROM r""",
    "more_bags": _E + f" SELECT ref, len({_QT('text')}) AS search, len(list_distinct(list_filter({_bag('text', '[a-z0-9]+', P.HARNESS_STOP)}, lambda x: length(x) >= 2))) AS harness, len({_ST.format('text')}) AS shadow, len(list_distinct(list_filter({_bag('text', '[a-z][a-z0-9]{3,}', P.AUDIT_STOP)}, lambda x: NOT list_contains(['stores', 'dark', 'mode'], x)))) AS owned FROM e",
    "bag_cosines": _BOTH + f", z AS (SELECT e.ref, {_GB2('e.text')} AS x, {_GB2('e2.text')} AS y FROM e JOIN e2 ON e.ref = e2.ref) SELECT ref, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE CAST(floor(len(list_intersect(x, y)) / (sqrt(len(x)) * sqrt(len(y))) * 10000 + 0.5e0) AS BIGINT) END AS cosine FROM z",
    "audit_keys": _E + f""", l AS (SELECT ref, starts_with({_STRIP.format('text')}, 'Long-form notes live in') AS hdr, trim(string_split({_STRIP.format('text')}, chr(10))[1]) AS line FROM e), b AS (SELECT *, CASE WHEN starts_with(line, '↪') THEN trim(substr(line, 2)) ELSE line END AS base FROM l),
t AS (SELECT *, trim(regexp_replace(lower(regexp_extract(base, '^([A-Za-z][\\pL\\pN_ &/+.\\-]{{1,46}}?)\\s*(?:\\([^)]*\\))?\\s*:', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS label, array_to_string(({_bag('base', '[a-z][a-z0-9]{2,}', P.AUDIT_STOP)})[1:6], '-') AS said FROM b)
SELECT ref, CASE WHEN hdr THEN 'notes-system-header' WHEN label <> '' AND NOT list_contains({_stop(P.AUDIT_GENERIC)}, label) THEN substr(label, 1, 48) WHEN said <> '' THEN substr(said, 1, 48) ELSE 'entry' END AS audit_key FROM t""",
    "shown_sizes": "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024e0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576e0) ELSE printf('%.1f GB', n / 1073741824e0) END AS size, CASE WHEN source = 'src1' THEN '~/' || lang ELSE '/home/' || source || '/' || lang END AS path FROM (SELECT *, n_chars * n_chars AS n FROM documents)",
    "parsed_dates": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%dT00:00:00+00:00') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 3 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+00:00')
  WHEN 4 THEN strftime(make_timestamp((event_id + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS at FROM events""",
    "store_summaries": _E + _ACTION + """, fr AS (SELECT a.*, o.store, o.n, CASE a.action WHEN 'rewrite_to_pointer' THEN 120 WHEN 'merge' THEN 120 WHEN 'archive_to_note' THEN 120 WHEN 'remove_after_archive' THEN 0 WHEN 'move_to_skill' THEN 80 WHEN 'move_to_note' THEN 80 END AS rest FROM act a JOIN o ON o.ref = a.ref),
su AS (SELECT store, count(*) AS entries, count(*) FILTER (action <> 'keep') AS actionable, CAST(0 AS BIGINT) AS broken, CAST(sum(n) AS BIGINT) AS chars, CAST(coalesce(sum(greatest(0, n - rest)), 0) AS BIGINT) AS recoverable, CASE store WHEN 'memory' THEN 15000e0 ELSE 6000e0 END AS lim FROM fr GROUP BY store)
SELECT store, entries, actionable, broken, chars, recoverable, CAST(floor(round(100 * chars / lim, 1) * 10 + 0.5e0) AS BIGINT) AS percent, CAST(floor(round(100 * greatest(0, chars - recoverable) / lim, 1) * 10 + 0.5e0) AS BIGINT) AS percent_after FROM su""",
    "top_shrink": _E + _ACTION + """, fr AS (SELECT a.ref, a.kind, a.action, o.n AS chars, o.n - CASE a.action WHEN 'rewrite_to_pointer' THEN 120 WHEN 'merge' THEN 120 WHEN 'archive_to_note' THEN 120 WHEN 'remove_after_archive' THEN 0 WHEN 'move_to_skill' THEN 80 WHEN 'move_to_note' THEN 80 END AS saved FROM act a JOIN o ON o.ref = a.ref)
SELECT ref, kind, action, chars, saved FROM fr WHERE saved > 0 ORDER BY saved DESC, ref LIMIT 10""",
    "relevance_lookup": _LEX + f", eh AS (SELECT ref, substr(sha256({_STRIP.format('text')}), 1, 16) AS hash FROM e)" + """, hs AS (SELECT lr.query_id, lr.id, lr.score, CASE WHEN lr.id % 3 <> 0 THEN eh.hash END AS hash FROM lr JOIN eh ON eh.ref = lr.id WHERE rank <= 20), bh AS (SELECT query_id, hash, max(score) AS rel FROM hs WHERE hash IS NOT NULL GROUP BY ALL),
f1 AS (SELECT query_id, eh.ref, rel FROM bh JOIN eh ON eh.hash = bh.hash), f2 AS (SELECT query_id, id AS ref, score AS rel FROM hs WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.query_id = hs.query_id AND f1.ref = hs.id))
SELECT query_id, ref, CAST(round(rel * 1e4) AS BIGINT) AS relevance, 'content_hash' AS found_by FROM f1 UNION ALL SELECT query_id, ref, CAST(round(rel * 1e4) AS BIGINT), 'entry_ref' FROM f2""",
    "candidate_turns": """WITH s AS (SELECT DISTINCT conv_id AS id, lower(coalesce(CASE conv_id % 5 WHEN 0 THEN 'Telegram' WHEN 1 THEN 'cli' WHEN 2 THEN 'cron' WHEN 3 THEN 'subagent' END, '')) AS source, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 700 AS INTEGER)) AS started_at FROM conversations)
SELECT session_id, source, count(*) AS turns, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(count(*) - 1 AS INTEGER) AS last FROM (SELECT conv_id AS session_id, source, text AS content FROM conversations c JOIN s ON s.id = c.conv_id WHERE started_at >= TIMESTAMP '2024-01-01 10:00:00' AND source NOT IN ('cron', 'subagent') AND NOT (conv_id % 3 = 0 AND turn = 1)) GROUP BY ALL""",
    "judged_policies": f"""WITH p AS (SELECT item_id AS policy, CASE WHEN item_id % 7 = 0 THEN 'other' ELSE 'retention/1' END AS schema, CASE WHEN item_id % 4 <> 0 THEN item_id % 12 - 1 END AS rd, CASE WHEN item_id % 5 <> 0 THEN item_id % 3 - 1 END AS pr, {_POLICY_FLAGS} FROM benchmark),
x AS (SELECT *, coalesce(prune_closed, false) OR coalesce(prune_unclosed, false) AS prunes, coalesce(prune_closed, false) OR coalesce(prune_unclosed, false) OR coalesce(delete_compression_parents, false) OR coalesce(drop_trigram, false) AS other FROM p)
SELECT policy, array_to_string(list_filter([CASE WHEN schema <> 'retention/1' THEN 'schema' END, CASE WHEN prunes AND rd IS NULL THEN 'retention_missing' END, CASE WHEN prunes AND rd < 1 THEN 'retention_not_positive' END, {", ".join(f"CASE WHEN {c} IS NULL THEN '{c}_not_boolean' END" for c in O.FLAGS)}, CASE WHEN pr < 0 THEN 'protect_recent_negative' END], lambda x: x IS NOT NULL), ',') AS errors,
  array_to_string(list_filter([CASE WHEN prunes AND rd < 7 THEN 'aggressive_retention' END, CASE WHEN prune_unclosed THEN 'prunes_unclosed' END, CASE WHEN delete_compression_parents THEN 'drops_originals' END, CASE WHEN drop_trigram THEN 'drops_trigram' END, CASE WHEN include_snapshots THEN 'targets_snapshots' END, CASE WHEN NOT coalesce(vacuum, false) AND other THEN 'no_vacuum' END], lambda x: x IS NOT NULL), ',') AS warnings,
  NOT (other OR coalesce(vacuum, false)) AS noop FROM x""",
}
