"""Queries of telemetry and extraction: events are projection turns, conversations and benchmark items are sessions and candidate facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.shared import stored
from ..functions.text import gate_tokens, overlap_coefficient
from ..operators import extract as E
from ..operators import telemetry as M
from .bind import entries, quoted, table
from .text_queries import _GB

TODAY = "2024-01-31"


def _turns(spark, d):
    """Events as projection turns: what a turn has follows from the event's kind, value and number; each fiftieth has no telemetry."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    i = F.col("event_id")
    path = F.when(i % 50 == 0, None).when(F.col("event_type") == "click", "daemon").when(F.col("event_type") == "view", "direct").otherwise("subprocess")
    return e.select(
        F.concat_ws("-", "user_id", k).alias("turn_id"), F.col("event_type").alias("lane"), F.col("ts").alias("generated_at"), F.col("ts").cast("date").alias("day"), i.alias("ordinal"), F.floor(F.least("value", F.lit(100.0))).cast("long").alias("savings"),
        F.floor("value").cast("long").alias("tokens"), (F.floor("value").cast("long") + 100).alias("full_tokens"), (i * 7 % 900).alias("latency"), path.alias("path"), (i % 3 == 0).alias("answered"), (i % 5 == 0).cast("int").alias("missing"), (i % 4).cast("int").alias("selected"), k.alias("ref"),
        (i % 6).alias("skipped"), (i % 997 == 0).alias("over_budget"), F.when(i % 991 == 0, "projected").otherwise("full").alias("active_block"), (i % 983 == 0).alias("raw_blocks"), F.when(i % 2 == 0, "memories-index:semantic").when(i % 3 == 0, "disabled:no-query").otherwise("lexical").alias("source"),
        (i % 8).alias("hits"), (i % 20 + 1).alias("requested"), (i % 61).alias("pool"), (i % 13 == 0).cast("int").alias("skipped_pins"), (i % 1013 == 0).cast("int").alias("safety_drops"), (i % 15 == 0).cast("int").alias("critical_missing"),
    )


#: The measures that shadow_metrics shows, in ten-thousandths where they are fractions.
COUNTS = ("turns", "min_savings", "p95_tokens", "p95_latency", "telemetry", "answers", "missing", "critical_missing", "raw_blocks", "over_budget", "active_not_full", "safety_drops", "skipped_pins", "violations")
RATES = ("avg_savings", "avg_tokens", "avg_full_tokens", "avg_selected", "avg_skipped", "semantic_rate", "telemetry_rate", "daemon_rate", "subprocess_rate", "avg_latency", "avg_hits", "avg_requested", "avg_pool", "missing_rate")


def shadow_latest(spark, d):
    return M.latest_per_turn(_turns(spark, d)).select("turn_id", "ordinal", "generated_at")


def shadow_metrics(spark, d):
    turns = M.latest_per_turn(_turns(spark, d))
    s = M.summary(turns).withColumn("errors", F.lit(0))
    g = M.gate_status(s.join(_replays(turns).agg(F.count("*").alias("violations"))))
    rates = [F.floor(F.col(c) * 10000 + 0.5).cast("long").alias(c) for c in RATES]
    return g.select(*[F.col(c).cast("long").alias(c) for c in COUNTS], *rates, F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"), "status", "decision")


def _replays(turns):
    """Turns of one lane and savings as replays of one question."""
    return M.determinism(turns.select(F.concat_ws("-", "lane", "savings").alias("grp"), F.sha2(F.col("savings").cast("string"), 256).alias("hash")))


def p95(spark, d):
    return _turns(spark, d).groupBy("path").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p95_latency"), F.count("*").alias("events"))


def top_refs(spark, d):
    return M.top_refs(_turns(spark, d).select("ref", "ordinal"))


def determinism(spark, d):
    return M.determinism(_turns(spark, d).select(F.col("turn_id").alias("grp"), F.sha2(F.concat_ws("|", "lane", "tokens"), 256).alias("hash")))


def lane_feedback(spark, d):
    f = M.lane_feedback(_turns(spark, d), F.lit(TODAY).cast("date"))
    return f.select("lane", "events", "answers", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("missing_rate", "selected_rate", "adjustment")], "health")


def lane_ranking(spark, d):
    f = M.lane_feedback(_turns(spark, d), F.lit(TODAY).cast("date"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    low = F.col("query_id")
    lanes = q.join(f.select("lane", "adjustment")).select("query_id", "lane", F.length("lane").alias("lane_order"), (low % (F.length("lane") - 3) == 0).alias("intent"), ((low * F.length("lane")) % 8 / 8.0).alias("topic"), F.when(low % 2 == 0, 1.0).otherwise(0.4).alias("availability"), "adjustment")
    return M.rank_lanes(lanes).select("query_id", "lane", "rank", F.round(F.col("score") * 1e6).cast("long").alias("score"))


def _messages(spark, d):
    """The driver's conversations, whole turns, with phrases that the rules look for."""
    c = table(spark, d, "conversations")
    said = F.array(*[F.lit(x) for x in SAID])
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", F.concat(F.get(said, ((F.col("conv_id") + F.col("turn")) % len(SAID)).cast("int")), "text").alias("content"))


SAID = ("", "I prefer dark mode. ", "[NOTE: ", "My coworker likes blue. ", "For now use tabs. ", "What if we moved? ", "ok ", "Remember the well-known rule. ")


def clean_user_turns(spark, d):
    return E.clean_user_turns(_messages(spark, d)).select("session_id", "ord", F.sha2("content", 256).alias("content_sha256"))


def qualifying_sessions(spark, d):
    return E.qualifying(E.clean_user_turns(_messages(spark, d)))


def transcript(spark, d):
    return E.transcripts(E.clean_user_turns(_messages(spark, d))).select("session_id", "chunk", F.sha2("transcript", 256).alias("transcript_sha256"), F.length("transcript").alias("chars"))


def _facts(spark, d):
    """A candidate fact per conversation turn: the turn in a phrase; the source is the turn or, each seventh, another text."""
    m = _messages(spark, d)
    fact = F.concat(F.get(F.array(*[F.lit(x) for x in FACTS]), (F.col("ord") % len(FACTS)).cast("int")), "content")
    return m.where("role = 'user'").select((F.col("session_id") * 1000 + F.col("ord")).alias("id"), "session_id", "ord", fact.alias("fact"), F.when(F.col("session_id") % 7 == 0, F.lit("Nothing of the kind was said")).otherwise(F.col("content")).alias("source"))


FACTS = ("User prefers ", "User does not ", "User jokingly ", "User's manager wants ", "See notes/ ", "User uses ")


def grounding(spark, d):
    f, s = F.col("fact"), F.col("source")
    return _facts(spark, d).select("id", F.floor(E.grounding_ratio(f, s) * 10000 + 0.5).cast("long").alias("grounding"), E.hyphen_grounded(f, s).alias("hyphens"))


def adjudication(spark, d):
    known = entries(spark, d).select(F.col("ref").alias("id"), "text")
    return E.adjudicate(_facts(spark, d), known).select("id", "verdict", "category")


def verification(spark, d):
    """Adjudicated facts with a verdict table that keeps two thirds; a fact without a verdict is rejected."""
    known = entries(spark, d).select(F.col("ref").alias("id"), "text")
    a = stored(E.adjudicate(_facts(spark, d), known).select("id", "verdict", "category"), "adjudicated")
    verdicts = a.where("id % 5 <> 0").select("id", (F.col("id") % 3 != 0).alias("keep"))
    return E.verified(a, verdicts).groupBy("verdict", "category").agg(F.count("*").alias("facts"))


def _allowed(spark, d):
    return _facts(spark, d).select("session_id", "ord", "id", F.when(F.col("ord") % 4 == 3, "REJECT").otherwise("ALLOW").alias("verdict"))


def session_caps(spark, d):
    return E.capped(_allowed(spark, d), 2, None).select("session_id", "ord", "verdict")


def night_cap(spark, d):
    return E.capped(_allowed(spark, d), 2, 10).select("session_id", "ord", "verdict")


def eval_precision_recall(spark, d):
    """Quality labels as gold, toxic labels' complement as what was extracted."""
    l = table(spark, d, "labels")
    got, gold = F.col("toxic") == 0, F.col("quality") == 1
    return l.agg(F.count_if(got & gold).alias("tp"), F.count_if(got & ~gold).alias("fp"), F.count_if(~got & gold).alias("fn"), F.floor(F.count_if(got & gold) / F.count_if(got) * 10000 + 0.5).cast("long").alias("precision_bp"), F.floor(F.count_if(got & gold) / F.count_if(gold) * 10000 + 0.5).cast("long").alias("recall_bp"))


def stem_overlap(spark, d):
    """Overlap of stems between each turn's fact and its source."""
    return _facts(spark, d).select("id", F.floor(overlap_coefficient(gate_tokens(F.col("fact")), gate_tokens(F.col("source"))) * 10000 + 0.5).cast("long").alias("overlap"))


QUERIES = {f.__name__: f for f in (shadow_latest, shadow_metrics, p95, top_refs, determinism, lane_feedback, lane_ranking, clean_user_turns, qualifying_sessions, transcript, grounding, adjudication, verification, session_caps, night_cap, eval_precision_recall, stem_overlap)}

_T = """WITH t0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id AS i FROM events),
t AS (SELECT user_id || '-' || k AS turn_id, event_type AS lane, ts AS generated_at, CAST(ts AS DATE) AS day, event_id AS ordinal, CAST(floor(least(value, 100e0)) AS BIGINT) AS savings, CAST(floor(value) AS BIGINT) AS tokens, event_id * 7 % 900 AS latency,
  CASE WHEN i % 50 = 0 THEN NULL WHEN event_type = 'click' THEN 'daemon' WHEN event_type = 'view' THEN 'direct' ELSE 'subprocess' END AS path, event_id % 3 = 0 AS answered, CAST(event_id % 5 = 0 AS INTEGER) AS missing, event_id % 4 AS selected, k AS ref, i FROM t0),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY generated_at DESC, ordinal DESC) AS n FROM t) WHERE n = 1)"""
_LF = _T + f""", f0 AS (SELECT *, date_diff('day', day, DATE '{TODAY}') AS age FROM (SELECT *, row_number() OVER (PARTITION BY lane, turn_id ORDER BY ordinal) AS n FROM t) WHERE n = 1),
f1 AS (SELECT *, exp(-age / 7e0) AS w FROM f0 WHERE age <= 14),
f2 AS (SELECT lane, count(*) AS events, count(*) FILTER (answered) AS answers, count(*) FILTER (path = 'subprocess') AS sub, sum(w) FILTER (answered) AS wa, sum(w * missing) FILTER (answered) AS wm, sum(w * selected) FILTER (answered) AS ws FROM f1 GROUP BY 1),
f3 AS (SELECT *, CASE WHEN answers > 0 THEN wm / greatest(wa, 1e-9) ELSE 0e0 END AS missing_rate, CASE WHEN answers > 0 THEN ws / greatest(wa, 1e-9) ELSE 0e0 END AS selected_rate, CAST(sub AS DOUBLE) / greatest(events, 1) AS sr FROM f2),
f AS (SELECT *, CASE WHEN events >= 3 AND answers >= 5 THEN greatest(-0.75e0, least(0.5e0, least(0.35e0, selected_rate * 0.1e0) - least(0.6e0, missing_rate) - least(0.4e0, sr))) ELSE 0e0 END AS adjustment,
  CASE WHEN events < 3 OR answers < 5 THEN 'insufficient' WHEN missing_rate > 0 OR sr > 0 THEN 'warn' ELSE 'ok' END AS health FROM f3)"""
_M = "WITH m AS (SELECT conv_id AS session_id, turn AS ord, role, [" + ", ".join(map(quoted, SAID)) + f"][(conv_id + turn) % {len(SAID)} + 1] || text AS content FROM conversations)"
_STRIPC = "trim(coalesce(content, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_AUTO = quoted("(?i)" + "|".join(f"(?:{p})" for p in E.AUTOMATION))
_U = _M + f", u AS (SELECT session_id, ord, {_STRIPC} AS content FROM m WHERE role = 'user' AND length({_STRIPC}) >= 12 AND NOT regexp_matches({_STRIPC}, {_AUTO}))"
_WORDS = " OR ".join(f"contains(lower(content), {quoted(w)})" for w in P.SIGNAL_WORDS)
_F = _M + ", fa AS (SELECT session_id * 1000 + ord AS id, session_id, ord, [" + ", ".join(map(quoted, FACTS)) + f"][ord % {len(FACTS)} + 1] || content AS fact, CASE WHEN session_id % 7 = 0 THEN 'Nothing of the kind was said' ELSE content END AS source FROM m WHERE role = 'user')"
_GT = lambda c: _GB.replace("text", c)
_FW = "[" + ", ".join(map(quoted, P.FRAME_WORDS)) + "]"
_GR = _F + f", gr AS (SELECT *, list_filter({_GT('fact')}, lambda x: NOT list_contains({_FW}, x)) AS fw, {_GT('source')} AS sw FROM fa), g AS (SELECT *, CASE WHEN len(fw) = 0 THEN 0e0 ELSE CAST(len(list_intersect(fw, sw)) AS DOUBLE) / len(fw) END AS ratio FROM gr)"
_HY = "len(list_filter(regexp_extract_all(regexp_replace(fact, '[À-ɏ]', 'q', 'g'), '\\b\\w+(?:-\\w+)+\\b'), lambda x: NOT contains(regexp_replace(lower(regexp_replace(source, '[À-ɏ]', 'q', 'g')), '[\\s-]+', '', 'g'), regexp_replace(lower(x), '[\\s-]+', '', 'g')))) = 0"
_CAP = _F + ", al AS (SELECT session_id, ord, CASE WHEN ord % 4 = 3 THEN 'REJECT' ELSE 'ALLOW' END AS v FROM fa), c1 AS (SELECT *, CASE WHEN v = 'ALLOW' THEN sum(CAST(v = 'ALLOW' AS INTEGER)) OVER (PARTITION BY session_id ORDER BY ord) END AS r FROM al), c2 AS (SELECT session_id, ord, CASE WHEN v = 'ALLOW' AND r > 2 THEN 'REVIEW' ELSE v END AS v FROM c1)"

SQL = {
    "shadow_latest": _T + " SELECT turn_id, ordinal, generated_at FROM lt",
    "shadow_metrics": _T + f""", a0 AS (SELECT count(*) AS turns, min(savings) AS min_savings, quantile_disc(tokens, 0.95) AS p95_tokens, quantile_disc(latency, 0.95) FILTER (path IS NOT NULL) AS p95_latency, count(path) AS telemetry, count(*) FILTER (answered) AS answers,
  CAST(sum(missing) FILTER (answered) AS BIGINT) AS missing, count(*) FILTER (answered AND i % 15 = 0) AS critical_missing, count(*) FILTER (i % 983 = 0) AS raw_blocks, count(*) FILTER (i % 997 = 0) AS over_budget, count(*) FILTER (i % 991 = 0) AS active_not_full, count(*) FILTER (i % 1013 = 0) AS safety_drops, count(*) FILTER (i % 13 = 0) AS skipped_pins, CAST(0 AS BIGINT) AS violations,
  round(avg(savings), 2) AS avg_savings, round(avg(tokens), 2) AS avg_tokens, round(avg(tokens + 100), 2) AS avg_full_tokens, round(avg(selected), 2) AS avg_selected, round(avg(i % 6), 2) AS avg_skipped, CAST(count(*) FILTER (i % 2 = 0) AS DOUBLE) / count(*) AS semantic_rate, CAST(count(path) AS DOUBLE) / count(*) AS telemetry_rate,
  CAST(count(*) FILTER (path = 'daemon') AS DOUBLE) / count(path) AS daemon_rate, CAST(count(*) FILTER (path = 'subprocess') AS DOUBLE) / count(path) AS subprocess_rate, round(avg(latency) FILTER (path IS NOT NULL), 2) AS avg_latency, round(avg(i % 8) FILTER (path IS NOT NULL), 2) AS avg_hits, round(avg(i % 20 + 1) FILTER (path IS NOT NULL), 2) AS avg_requested,
  round(avg(i % 61) FILTER (path IS NOT NULL), 2) AS avg_pool, CAST(sum(missing) FILTER (answered) AS DOUBLE) / count(*) FILTER (answered) AS missing_rate FROM lt),
a1 AS (SELECT *, list_filter([CASE WHEN turns = 0 THEN 'no_events' END, CASE WHEN active_not_full > 0 THEN 'active_block' END, CASE WHEN raw_blocks > 0 THEN 'raw_blocks' END, CASE WHEN over_budget > 0 THEN 'over_budget' END, CASE WHEN safety_drops > 0 THEN 'safety_pins' END, CASE WHEN violations > 0 THEN 'determinism' END, CASE WHEN critical_missing > 0 THEN 'critical_pins' END,
    CASE WHEN telemetry_rate < 1 THEN 'telemetry' END, CASE WHEN telemetry > 0 AND daemon_rate < 0.95e0 THEN 'daemon' END, CASE WHEN telemetry > 0 AND subprocess_rate > 0 THEN 'subprocess' END, CASE WHEN telemetry > 0 AND p95_latency > 500 THEN 'latency' END], lambda x: x IS NOT NULL) AS f,
  list_filter([CASE WHEN avg_savings < 40 THEN 'savings' END, CASE WHEN semantic_rate < 1 THEN 'semantic' END, CASE WHEN answers = 0 THEN 'no_answers' END, CASE WHEN answers BETWEEN 1 AND 4 THEN 'few_answers' END, CASE WHEN answers >= 5 AND missing_rate > 0.1e0 THEN 'missing' END, CASE WHEN skipped_pins > 0 THEN 'skipped_pins' END], lambda x: x IS NOT NULL) AS w FROM a0)
SELECT {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS)}, {", ".join(f"CAST(floor({c} * 10000 + 0.5e0) AS BIGINT) AS {c}" for c in RATES)}, array_to_string(f, ',') AS failures, array_to_string(w, ',') AS warnings, CASE WHEN len(f) > 0 THEN 'FAIL' WHEN len(w) > 0 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN len(f) > 0 THEN 'FAIL' WHEN len(w) > 0 THEN 'WARN' ELSE 'PASS' END AS decision FROM a1""",
    "p95": _T + " SELECT path, quantile_disc(latency, 0.95) AS p95_latency, count(*) AS events FROM t GROUP BY 1",
    "top_refs": _T + " SELECT ref, count(*) AS times, min(ordinal) AS first_seen FROM t GROUP BY 1 ORDER BY times DESC, first_seen LIMIT 20",
    "determinism": _T + " SELECT turn_id AS grp, count(DISTINCT sha256(lane || '|' || tokens)) AS hashes, count(*) AS events FROM t GROUP BY 1 HAVING hashes > 1",
    "lane_feedback": _LF + " SELECT lane, events, answers, CAST(round(missing_rate * 1e6) AS BIGINT) AS missing_rate, CAST(round(selected_rate * 1e6) AS BIGINT) AS selected_rate, CAST(round(adjustment * 1e6) AS BIGINT) AS adjustment, health FROM f",
    "lane_ranking": _LF + """, l AS (SELECT item_id AS query_id, lane, length(lane) AS lo, 2 * CASE WHEN item_id % (length(lane) - 3) = 0 THEN 1e0 ELSE 0e0 END + 3 * ((item_id * length(lane)) % 8 / 8e0) + CASE WHEN item_id % 2 = 0 THEN 1e0 ELSE 0.4e0 END + adjustment AS score FROM benchmark, f)
SELECT query_id, lane, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lo) AS rank, CAST(round(score * 1e6) AS BIGINT) AS score FROM l""",
    "clean_user_turns": _U + " SELECT session_id, ord, sha256(content) AS content_sha256 FROM u",
    "qualifying_sessions": _U + f" SELECT session_id, count(*) AS turns FROM u GROUP BY 1 HAVING count(*) >= 2 AND bool_or({_WORDS})",
    "transcript": _U + """, l AS (SELECT session_id, ord, 'User: ' || regexp_replace(content, '\\s+', ' ', 'g') AS line, CAST((row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1) // 12 AS INTEGER) AS chunk FROM u),
b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY session_id, chunk ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
x AS (SELECT session_id, chunk, string_agg(substr(line, 1, CAST(2600 - before AS BIGINT)), chr(10) ORDER BY ord) AS t FROM b WHERE before < 2600 GROUP BY ALL) SELECT session_id, chunk, sha256(t) AS transcript_sha256, length(t) AS chars FROM x""",
    "grounding": _GR + f" SELECT id, CAST(floor(ratio * 10000e0 + 0.5e0) AS BIGINT) AS grounding, {_HY} AS hyphens FROM g",
    "session_caps": _CAP + " SELECT session_id, ord, v AS verdict FROM c2",
    "night_cap": _CAP + ", c3 AS (SELECT *, sum(CAST(v = 'ALLOW' AS INTEGER)) OVER (ORDER BY session_id, ord) AS r FROM c2) SELECT session_id, ord, CASE WHEN v = 'ALLOW' AND r > 10 THEN 'REVIEW' ELSE v END AS verdict FROM c3",
    "eval_precision_recall": "SELECT count(*) FILTER (toxic = 0 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality <> 1) AS fp, count(*) FILTER (toxic <> 0 AND quality = 1) AS fn, CAST(floor(CAST(count(*) FILTER (toxic = 0 AND quality = 1) AS DOUBLE) / count(*) FILTER (toxic = 0) * 10000e0 + 0.5e0) AS BIGINT) AS precision_bp, CAST(floor(CAST(count(*) FILTER (toxic = 0 AND quality = 1) AS DOUBLE) / count(*) FILTER (quality = 1) * 10000e0 + 0.5e0) AS BIGINT) AS recall_bp FROM labels",
    "stem_overlap": _F + f", s AS (SELECT id, list_distinct(list_transform({_GT('fact')}, lambda w: substr(w, 1, 5))) AS x, list_distinct(list_transform({_GT('source')}, lambda w: substr(w, 1, 5))) AS y FROM fa) SELECT id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE CAST(floor(CAST(len(list_intersect(x, y)) AS DOUBLE) / least(len(x), len(y)) * 10000e0 + 0.5e0) AS BIGINT) END AS overlap FROM s",
}
