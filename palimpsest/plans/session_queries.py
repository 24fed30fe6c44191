"""Queries over session stores: conversations as a small store, orders with lineitem as a large one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import HIDDEN_SOURCES
from ..functions.shared import shared_dir, stored
from ..operators import sessions as S
from ..operators.fulltext import Index, words_of
from .bind import table

NOW = "1998-09-01 00:00:00"
DAYS, PROTECT, PROTECTED = 400, 2, ["1-URGENT"]
PROBES = ["the", "ing", "ent", "and", "tion"]


def _small(spark, d):
    """Sessions and messages from conversations; source, parent and end reason follow from the id."""
    c = table(spark, d, "conversations")
    messages = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("turn").alias("timestamp"), "role", F.col("text").alias("content"))
    source = F.element_at(F.array(*[F.lit(x) for x in ("telegram", "cli", "cron", "subagent", "web")]), (F.col("id") % 5 + 1).cast("int"))
    sessions = c.select(F.col("conv_id").alias("id")).distinct().select("id", source.alias("source"), F.when(F.col("id") % 5 == 4, F.col("id") - 1).alias("parent_session_id"), F.when(F.col("id") % 5 == 3, "compression").alias("end_reason"))
    return sessions, messages


def _large(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    sessions = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("ended_at"), F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") - 1).alias("parent_session_id"), F.when(F.col("o_orderkey") % 3 == 0, "compression").alias("end_reason"))
    messages = l.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("size"))
    return sessions, messages


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _targets(spark, d):
    s, m = _large(spark, d)
    return S.retention_targets(S.last_activity(s, m), _now(), DAYS, PROTECT, PROTECTED)


def _states(spark, d):
    return S.compression_states(_large(spark, d)[0], _targets(spark, d), _now(), PROTECT, PROTECTED)


def _gone(spark, d):
    """All that the policy deletes, written once for the joins that read it several times."""
    s, m = _large(spark, d)
    return stored(S.collect_targets(S.last_activity(s, m), _now(), DAYS, PROTECT, PROTECTED), "gone")


def session_first_user_message(spark, d):
    s, m = _small(spark, d)
    seen = s.where(~F.col("source").isin(*HIDDEN_SOURCES))
    return seen.join(S.first_user_message(m), F.col("id") == F.col("session_id"), "left").select("id", "source", "first_message")


def session_docs(spark, d):
    """What is embedded for a session: source, title and the message's first 500 characters."""
    first = session_first_user_message(spark, d)
    return first.select("id", F.concat_ws(" | ", F.nullif("source", F.lit("")), F.left(F.nullif("first_message", F.lit("")), F.lit(500))).alias("document"))


def session_age_histogram(spark, d):
    return S.age_histogram(_large(spark, d)[0], _now())


def session_metrics(spark, d):
    s, m = _large(spark, d)
    a = S.last_activity(s, m)
    return a.agg(F.count("*").alias("sessions"), F.count("ended_at").alias("closed"), F.min("started_at").alias("first_start"), F.max("last_activity").alias("last_seen"), F.count_if(F.datediff(_now(), F.col("last_activity")) >= 14).alias("dormant"))


def source_histogram(spark, d):
    return _large(spark, d)[0].groupBy("source").agg(F.count("*").alias("sessions"))


def end_reasons(spark, d):
    return _large(spark, d)[0].groupBy(F.coalesce("end_reason", F.lit("none")).alias("end_reason")).agg(F.count("*").alias("sessions"))


def last_activity(spark, d):
    s, m = _large(spark, d)
    return S.last_activity(s, m).select("id", "last_activity")


def prune_closed_targets(spark, d):
    return _targets(spark, d).where("reason = 'closed'").select("id", "source")


def prune_unclosed_targets(spark, d):
    return _targets(spark, d).where("reason = 'unclosed'").select("id", "source")


def compression_semi(spark, d):
    return S.compression_parents(_small(spark, d)[0]).select("id", "source")


def compression_bytes(spark, d):
    s, m = _large(spark, d)
    parents = S.compression_parents(s).select(F.col("id").alias("session_id"))
    return m.join(parents, "session_id", "left_semi").agg(F.count("*").alias("messages"), F.sum(F.col("size").cast("long")).alias("bytes"))


def compression_targets(spark, d):
    return _states(spark, d).where("state = 'delete'").select("id")


def compression_states(spark, d):
    return _states(spark, d).groupBy("state").agg(F.count("*").alias("sessions"), F.min("id").alias("first"))


def cleanup_targets(spark, d):
    return _gone(spark, d)


def target_counts(spark, d):
    s, m = _large(spark, d)
    return S.target_counts(s, m, _gone(spark, d), _states(spark, d))


def children_unlinked(spark, d):
    s, _ = _large(spark, d)
    return S.unlinked_children(s, _gone(spark, d)).select("id", "parent_session_id")


def cleanup_after_counts(spark, d):
    s, m = _large(spark, d)
    left_s, left_m = S.cleanup(s, m, _gone(spark, d))
    return left_s.agg(F.count("*").alias("sessions"), F.count("parent_session_id").alias("linked")).join(left_m.agg(F.count("*").alias("messages")))


def orphan_check(spark, d):
    s, m = _large(spark, d)
    return S.orphans(*S.cleanup(s, m, _gone(spark, d)))


def word_index_df(spark, d):
    return S.word_index(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).groupBy("word").agg(F.count("*").alias("documents"))


def trigram_index(spark, d):
    return S.trigram_index(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).groupBy("gram").agg(F.count("*").alias("documents"))


def search_impact(spark, d):
    return S.search_impact(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), PROBES)


def _index(spark, d, kinds):
    """All documents indexed in two appends, of which the second replaces a third of the first with the same texts, and merged."""
    index = Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", kinds)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    index.append(docs.where(F.col("id") % 3 != 1))
    index.append(docs.where(F.col("id") % 3 != 2))
    index.merge()
    return index, docs


def phrase_search(spark, d):
    """Documents that hold the second to fourth word of a benchmark item one after the other, and how often."""
    w = words_of(F.col("text"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(w, 2, 3), " ").alias("text"))
    return _index(spark, d, ("word",))[0].phrases(asked)


def substring_search(spark, d):
    """Documents that hold twelve characters of a benchmark item, wherever words begin."""
    index, docs = _index(spark, d, ("gram",))
    return index.substrings(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 4, 12).alias("text")), docs)


def indexed_topk(spark, d):
    """The ten documents, with those equal to the tenth, that hold most of the weight of a benchmark item's words."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words_of(F.col("text")).alias("tokens"))
    best, _ = _index(spark, d, ("word",))[0].best(asked, 10)
    return best.select("query_id", "id", F.round(F.col("score") * 1e6).cast("long").alias("score"))


QUERIES = {f.__name__: f for f in (session_first_user_message, session_docs, session_age_histogram, session_metrics, source_histogram, end_reasons, last_activity, prune_closed_targets, prune_unclosed_targets, compression_semi, compression_bytes, compression_targets, compression_states, cleanup_targets, target_counts, children_unlinked, cleanup_after_counts, orphan_check, word_index_df, trigram_index, search_impact, phrase_search, substring_search, indexed_topk)}

_SMALL = """WITH m AS (SELECT conv_id AS session_id, turn AS id, turn AS timestamp, role, text AS content FROM conversations),
s AS (SELECT id, CASE id % 5 WHEN 0 THEN 'telegram' WHEN 1 THEN 'cli' WHEN 2 THEN 'cron' WHEN 3 THEN 'subagent' ELSE 'web' END AS source,
  CASE WHEN id % 5 = 4 THEN id - 1 END AS parent_session_id, CASE WHEN id % 5 = 3 THEN 'compression' END AS end_reason FROM (SELECT DISTINCT conv_id AS id FROM conversations))"""
_LARGE = f"""WITH s AS (SELECT o_orderkey AS id, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS ended_at, o_orderpriority AS source,
  CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END AS parent_session_id, CASE WHEN o_orderkey % 3 = 0 THEN 'compression' END AS end_reason FROM orders),
m AS (SELECT l_orderkey AS session_id, l_shipdate AS timestamp, l_quantity AS size FROM lineitem),
a AS (SELECT s.*, coalesce(x.t, ended_at, started_at) AS last_activity FROM s LEFT JOIN (SELECT session_id, max(timestamp) AS t FROM m GROUP BY 1) x ON s.id = x.session_id),
i AS (SELECT *, date_diff('day', CAST(last_activity AS DATE), DATE '1998-09-01') AS idle FROM a),
t AS (SELECT *, CASE WHEN ended_at IS NOT NULL THEN 'closed' ELSE 'unclosed' END AS reason FROM a
  WHERE (source IS NULL OR source NOT IN ('1-URGENT')) AND last_activity < TIMESTAMP '{NOW}' - to_seconds({DAYS} * 86400) AND last_activity < TIMESTAMP '{NOW}' - to_seconds({PROTECT} * 86400)),
cs AS (SELECT p.id, CASE WHEN p.parent_session_id IN (SELECT id FROM s WHERE end_reason = 'compression') THEN 'deferred' WHEN NOT EXISTS (SELECT 1 FROM s c WHERE c.parent_session_id = p.id AND c.id NOT IN (SELECT id FROM t)) THEN 'demoted' ELSE 'delete' END AS state
  FROM s p WHERE end_reason = 'compression' AND started_at < TIMESTAMP '{NOW}' - to_seconds({PROTECT} * 86400) AND (source IS NULL OR source NOT IN ('1-URGENT')) AND EXISTS (SELECT 1 FROM s c WHERE c.parent_session_id = p.id)),
g AS (SELECT id, source, reason FROM t UNION ALL SELECT cs.id, s.source, 'compression_parent' FROM cs JOIN s ON s.id = cs.id WHERE state = 'delete' AND cs.id NOT IN (SELECT id FROM t)),
ls AS (SELECT s.id, CASE WHEN s.parent_session_id IN (SELECT id FROM g) THEN NULL ELSE s.parent_session_id END AS parent_session_id FROM s WHERE s.id NOT IN (SELECT id FROM g)),
lm AS (SELECT * FROM m WHERE session_id NOT IN (SELECT id FROM g)) """
_FIRST = ", f AS (SELECT session_id, arg_min(content, row(timestamp, id)) AS first_message FROM m WHERE role = 'user' AND trim(content) <> '' GROUP BY 1)"
_AGE = "epoch_us(TIMESTAMP '1998-09-01') - epoch_us(started_at)"


def _bucket(lo, hi, name):
    day = 86400000000
    return f"count(*) FILTER ({_AGE} >= {lo * day}" + (f" AND {_AGE} < {hi * day}" if hi is not None else "") + f") AS {name}"


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
SQL = {
    "phrase_search": f"""WITH w AS (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id AS id, {_WORDS} AS w FROM documents)),
p AS (SELECT query_id, unnest(p) AS t, generate_subscripts(p, 1) AS j, len(p) AS k FROM (SELECT item_id AS query_id, {_WORDS}[2:4] AS p FROM benchmark)),
s AS (SELECT query_id, id FROM w JOIN p USING (t) GROUP BY query_id, id, pos - j HAVING count(*) = any_value(k)) SELECT query_id, id, count(*) AS hits FROM s GROUP BY ALL""",
    "substring_search": "SELECT item_id AS query_id, doc_id AS id FROM documents d, benchmark b WHERE length(substr(b.text, 4, 12)) > 0 AND contains(lower(d.text), lower(substr(b.text, 4, 12)))",
    "indexed_topk": f"""WITH w AS (SELECT doc_id AS id, unnest(list_distinct({_WORDS})) AS t FROM documents), f AS (SELECT t, count(*) AS df FROM w GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS})) AS t FROM benchmark), a AS (SELECT query_id, t, ln(1 + n / coalesce(df, 1)) AS wt FROM q LEFT JOIN f USING (t), n),
s AS (SELECT query_id, id, sum(wt) / any_value(whole) AS score FROM w JOIN a USING (t) JOIN (SELECT query_id, sum(wt) AS whole FROM a GROUP BY 1) USING (query_id) GROUP BY ALL)
SELECT query_id, id, CAST(round(score * 1e6) AS BIGINT) AS score FROM s QUALIFY rank() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC) <= 10""",
    "session_first_user_message": _SMALL + _FIRST + " SELECT s.id, source, first_message FROM s LEFT JOIN f ON s.id = f.session_id WHERE source NOT IN ('subagent', 'tool')",
    "session_docs": _SMALL + _FIRST + " SELECT s.id, concat_ws(' | ', nullif(source, ''), substr(nullif(first_message, ''), 1, 500)) AS document FROM s LEFT JOIN f ON s.id = f.session_id WHERE source NOT IN ('subagent', 'tool')",
    "session_age_histogram": _LARGE + "SELECT " + ", ".join(_bucket(*b) for b in S.AGE_BUCKETS) + ", count(*) FILTER (started_at IS NULL) AS unknown FROM s",
    "session_metrics": _LARGE + "SELECT count(*) AS sessions, count(ended_at) AS closed, min(started_at) AS first_start, max(last_activity) AS last_seen, count(*) FILTER (idle >= 14) AS dormant FROM i",
    "source_histogram": _LARGE + "SELECT source, count(*) AS sessions FROM s GROUP BY 1",
    "end_reasons": _LARGE + "SELECT coalesce(end_reason, 'none') AS end_reason, count(*) AS sessions FROM s GROUP BY 1",
    "last_activity": _LARGE + "SELECT id, last_activity FROM a",
    "prune_closed_targets": _LARGE + "SELECT id, source FROM t WHERE reason = 'closed'",
    "prune_unclosed_targets": _LARGE + "SELECT id, source FROM t WHERE reason = 'unclosed'",
    "compression_semi": _SMALL + " SELECT id, source FROM s WHERE end_reason = 'compression' AND EXISTS (SELECT 1 FROM s c WHERE c.parent_session_id = s.id)",
    "compression_bytes": _LARGE + "SELECT count(*) AS messages, CAST(sum(CAST(size AS BIGINT)) AS BIGINT) AS bytes FROM m WHERE session_id IN (SELECT id FROM s WHERE end_reason = 'compression' AND EXISTS (SELECT 1 FROM s c WHERE c.parent_session_id = s.id))",
    "compression_targets": _LARGE + "SELECT id FROM cs WHERE state = 'delete'",
    "compression_states": _LARGE + "SELECT state, count(*) AS sessions, min(id) AS first FROM cs GROUP BY 1",
    "cleanup_targets": _LARGE + "SELECT id, reason FROM g",
    "target_counts": _LARGE + """SELECT (SELECT count(*) FROM g) AS sessions_to_delete, (SELECT count(*) FROM g WHERE reason = 'closed') AS prune_closed, (SELECT count(*) FROM g WHERE reason = 'unclosed') AS prune_unclosed,
  (SELECT count(*) FROM cs WHERE state = 'delete') AS compression_parents, (SELECT count(*) FROM cs WHERE state = 'demoted') AS demoted, (SELECT count(*) FROM cs WHERE state = 'deferred') AS deferred,
  (SELECT count(*) FROM m WHERE session_id IN (SELECT id FROM g)) AS messages_to_delete, (SELECT count(*) FROM s WHERE parent_session_id IN (SELECT id FROM g) AND id NOT IN (SELECT id FROM g)) AS children_unlinked""",
    "children_unlinked": _LARGE + "SELECT id, parent_session_id FROM s WHERE parent_session_id IN (SELECT id FROM g) AND id NOT IN (SELECT id FROM g)",
    "cleanup_after_counts": _LARGE + "SELECT (SELECT count(*) FROM ls) AS sessions, (SELECT count(parent_session_id) FROM ls) AS linked, (SELECT count(*) FROM lm) AS messages",
    "orphan_check": _LARGE + "SELECT (SELECT count(*) FROM lm WHERE session_id NOT IN (SELECT id FROM ls)) AS orphan_messages, (SELECT count(*) FROM ls WHERE parent_session_id IS NOT NULL AND parent_session_id NOT IN (SELECT id FROM ls)) AS broken_parents",
    "word_index_df": "SELECT word, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY 1",
    "trigram_index": "SELECT gram, count(*) AS documents FROM (SELECT DISTINCT doc_id, substr(lower(text), i, 3) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents)) GROUP BY 1",
    "search_impact": "SELECT probe, count(*) FILTER (contains(lower(text), probe)) AS substring_hits, count(*) FILTER (list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), probe)) AS word_hits FROM documents, (SELECT unnest(['" + "', '".join(PROBES) + "']) AS probe) GROUP BY 1",
}
