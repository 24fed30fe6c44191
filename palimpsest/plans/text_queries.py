"""Queries of the text functions, the audit, pins and the intake gate. Oracles are written for RE2: accented letters stand as q where word borders matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DUP_NEAR, FUZZY_MATCH
from ..functions import patterns as P
from ..functions import text as X
from ..functions.shared import stored
from ..operators import audit as A
from ..operators import gate as G
from ..operators import similarity as S
from ..operators import temporal as T
from .bind import ALTERED_SQL, ENTRIES_SQL, TODAY, altered, entries, quoted, table

def _t():
    return F.col("text")



def _scaled(c, name):
    return F.floor(c * 10000 + 0.5).cast("long").alias(name)


def content_hash(spark, d):
    return entries(spark, d).select("ref", X.content_hash(_t()).alias("content_hash"))


def slug(spark, d):
    return entries(spark, d).select("ref", X.slug(_t()).alias("slug"), X.first_line(_t()).alias("first_line"))


def derive_key(spark, d):
    return entries(spark, d).select("ref", X.fact_key(_t()).alias("fact_key"))


def topic_of(spark, d):
    return entries(spark, d).select("ref", X.topic_of(_t()).alias("topic"), X.is_pointer(_t()).alias("is_pointer"), X.is_header(_t()).alias("is_header"))


def est_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.est_tokens(_t()).alias("tokens"), X.entry_weight(_t()).alias("weight"))


def extract_paths(spark, d):
    return entries(spark, d).select("ref", F.array_join(X.paths(_t()), "|").alias("paths"), F.size(F.filter(X.paths(_t()), X.is_file_path)).alias("files"))


def latest_date(spark, d):
    return entries(spark, d).select("ref", X.latest_date(_t()).cast("string").alias("latest"))


def redact_secrets(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(X.redact(F.col("html")), 256).alias("redacted_sha256"))


def clean_labels(spark, d):
    return entries(spark, d).select("ref", X.clean_label(_t()).alias("label"))


def token_bags(spark, d):
    """Sizes of the seven bags' main kinds: what each tokenizer leaves."""
    return entries(spark, d).select("ref", F.size(X.audit_tokens(_t())).alias("audit"), F.size(X.subject_tokens(_t())).alias("subject"), F.size(X.gate_tokens(_t())).alias("gate"), F.size(X.fact_tokens(_t())).alias("fact"))


def signals(spark, d):
    names = ["temporal", "completion", "metric", "leading_date", "inline_date", "pointer", "preference", "reflection", "todo", "debug", "progress", "vague", "volatile", "activity", "sigil"]
    s = entries(spark, d).select("ref", A.signals(_t()).alias("s"))
    return s.select("ref", *[F.col(f"s.{n}").alias(n) for n in names])


def _audited(spark, d):
    return A.audit(entries(spark, d), F.lit(TODAY).cast("date"))


def _stored(spark, d):
    """The audit, written once for the pair joins that read it several times."""
    return stored(_audited(spark, d), "audit")


def entry_kinds(spark, d):
    return _audited(spark, d).select("ref", "kind", "chars")


def kind_counts(spark, d):
    return _audited(spark, d).groupBy("store", "kind").agg(F.count("*").alias("entries"))


def quality_scores(spark, d):
    return _audited(spark, d).select("ref", *[_scaled(F.col(f"scores.{c}"), c) for c in ("durability", "hot_memory_fit", "pointer_quality", "specificity", "staleness", "overall")])


def near_duplicates(spark, d):
    return A.duplicates(_stored(spark, d), DUP_NEAR).select("a", "b", "common", "either", F.when(F.col("common") >= 0.6 * F.col("either"), "strong").otherwise("near").alias("strength"))


def near_duplicate_classes(spark, d):
    """Entries of one bag of words as a class: its first entry, its members, how many other bags are near it, and how many pairs of entries that stands for."""
    a = _stored(spark, d).where("kind <> 'header'")
    members, pairs = S.similar_classes(stored(a.select(F.col("ref").alias("id"), X.audit_tokens(F.col("text")).alias("tokens")), "bags"), DUP_NEAR)
    size = members.groupBy("rep").agg(F.count("*").alias("members"))
    links = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = links.join(size, F.col("b") == F.col("rep")).groupBy("a").agg(F.count("*").alias("near"), F.sum("members").alias("others"))
    out = size.join(near, F.col("rep") == F.col("a"), "left")
    n = F.col("members")
    return out.select(F.col("rep").alias("first"), "members", F.coalesce("near", F.lit(0)).alias("near"), (n * (n - 1) / 2 + n * F.coalesce("others", F.lit(0))).cast("long").alias("pairs"))


def best_duplicate(spark, d):
    return A.best_duplicate(A.duplicates(_stored(spark, d), DUP_NEAR))


def contradictions(spark, d):
    return A.contradictions(_stored(spark, d))


def recommended_actions(spark, d):
    a = _stored(spark, d)
    merged = A.losers(a, DUP_NEAR)
    c = A.contradictions(a)
    return A.recommend(a, merged, c.select(F.col("a").alias("ref")).union(c.select("b"))).select("ref", "kind", "action")


def audit_summary(spark, d):
    return recommended_actions(spark, d).groupBy("action").agg(F.count("*").alias("entries"))


def intake_gate(spark, d):
    return entries(spark, d).select("ref", G.classify(_t()).alias("g")).select("ref", "g.verdict", "g.category")


def pin_classes(spark, d):
    return entries(spark, d).select("ref", G.pin_class(_t()).alias("pin"))


def nearest_existing(spark, d):
    """Each benchmark item's nearest entry by gate tokens."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), X.gate_tokens(_t()).alias("tokens"))
    known = entries(spark, d).select(F.col("ref").alias("id"), X.gate_tokens(_t()).alias("tokens"))
    return S.nearest(items, known).select("id", "best_id", "common", "either")


def containment_dup(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), X.gate_tokens(_t()).alias("tokens"))
    known = entries(spark, d).select(F.col("ref").alias("id"), X.gate_tokens(_t()).alias("tokens"))
    return S.containment(items, known).select("id", "common", "n")


def keyed(e):
    """Entries (ref, store, text) with what the version store tells facts apart by."""
    return e.select("ref", "store", "text", X.content_hash(_t()).alias("hash"), X.fact_key(_t()).alias("key"), X.is_pointer(_t()).alias("is_pointer"), X.fact_tokens(_t()).alias("tokens"))


def known_facts(e):
    """An entry table as the current facts of its stores: the first entry of each key."""
    return keyed(e).groupBy("store", F.col("key").alias("fact_key")).agg(F.min_by("hash", "ref").alias("hash"), F.min_by("tokens", "ref").alias("tokens"), F.min_by("text", "ref").alias("content"))


def match_decisions(spark, d):
    """All entries against the facts that an altered copy of all entries makes current."""
    e, known = stored(keyed(entries(spark, d)).drop("text"), "keyed"), stored(known_facts(altered(spark, d)).drop("content"), "known")
    return T.match(e, known, F.col("tokens"), FUZZY_MATCH).select("ref", "decision", "how", "fact_key")


def ingest(spark, d):
    """A pass over all entries against the facts of an altered copy; documents of the copy whose number ends in 7 are in the archives too."""
    a = altered(spark, d)
    archived = keyed(a).where("ref % 10 = 7").select(F.col("key").alias("fact_key"), F.col("text").alias("content"), F.concat(F.lit("2024-01-"), F.lpad((F.col("ref") % 28 + 1).cast("string"), 2, "0")).alias("archived_at"))
    out = T.ingest(stored(keyed(entries(spark, d)), "keyed"), stored(known_facts(a), "known"), archived, FUZZY_MATCH)
    return out.select("store", F.coalesce("op", F.lit("none")).alias("op"), "fact_key", "archived_at", "ref")


QUERIES = {f.__name__: f for f in (content_hash, slug, derive_key, topic_of, est_tokens, extract_paths, latest_date, redact_secrets, clean_labels, token_bags, signals, entry_kinds, kind_counts, quality_scores, near_duplicates, near_duplicate_classes, best_duplicate, contradictions, recommended_actions, audit_summary, intake_gate, pin_classes, nearest_existing, containment_dup, match_decisions, ingest)}

_E = "WITH " + ENTRIES_SQL
_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_FIRST = "trim(string_split(" + _STRIP.format("{0}") + ", chr(10))[1])"


def _says(p, c="ascii"):
    return f"regexp_matches({c}, {quoted('(?i)' + p)})"


def _slug(c, n=48):
    s = f"substr(trim(regexp_replace(lower(string_split({_STRIP.format(c)}, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '-'), 1, {n})"
    return f"CASE WHEN {s} = '' THEN 'entry' ELSE {s} END"


def _stop(words):
    return "[" + ", ".join(map(quoted, words)) + "]"


def _bag(c, pattern, stop):
    return f"list_filter(regexp_extract_all(lower({c}), '{pattern}'), lambda x: NOT list_contains({_stop(stop)}, x))"


_PATHS = f"regexp_extract_all(text, {quoted(P.PATH)}, 1)"
_CLEANPATHS = f"list_distinct_ordered({_PATHS})"
_A = ", a AS (SELECT *, regexp_replace(text, '[À-ɏ]', 'q', 'g') AS ascii FROM e)"
_SIG = _A + ", s AS (SELECT *, length(text) AS n, " + ", ".join(f"{_says(p)} AS {k}" for k, p in (("temporal", P.TEMPORAL), ("completion", P.COMPLETION), ("metric", P.METRIC), ("leading_date", P.LEADING_DATE), ("inline_date", P.INLINE_DATE), ("pointer", P.POINTER), ("preference", P.PREFERENCE), ("reflection", P.REFLECTION), ("todo", P.TODO), ("debug", P.DEBUG), ("progress", P.PROGRESS), ("vague", P.VAGUE), ("volatile", P.VOLATILE))) + f", {_says(P.COMPLETION)} OR {_says(P.ACTIVITY)} AS activity, starts_with({_STRIP.format('text')}, '↪') AS sigil, starts_with({_STRIP.format('text')}, 'Long-form notes live in') AS header, {_says(P.DURABLE_VERB)} AND NOT {_says(P.EVENT_VERB)} AS only_durable, {_says(P.STRONG_VAGUE)} AS strong_vague, {_says(P.PROCEDURE)} AS procedure FROM a)"
_KIND = _SIG + """, k0 AS (SELECT *, (completion OR activity) AND NOT (only_durable AND NOT temporal) AS event, metric AND NOT preference AS figure FROM s),
k1 AS (SELECT *, NOT preference AND (leading_date OR temporal OR inline_date) AND (event OR figure) AS dated FROM k0),
k AS (SELECT *, CASE WHEN header THEN 'header' WHEN sigil THEN 'pointer' WHEN reflection THEN 'status_update' WHEN debug AND NOT preference THEN 'debugging_finding'
  WHEN dated THEN CASE WHEN progress THEN 'project_progress' ELSE 'status_update' END WHEN figure AND NOT pointer THEN 'status_update' WHEN todo AND NOT pointer THEN 'todo_temporary'
  WHEN progress AND (inline_date OR metric) THEN 'project_progress' WHEN progress AND completion THEN 'project_progress' WHEN strong_vague AND n < 80 AND NOT pointer THEN 'malformed'
  WHEN preference AND NOT (leading_date OR completion) THEN 'preference_fact' WHEN n > CASE WHEN store = 'memory' THEN 350 ELSE 700 END AND NOT pointer THEN 'content_dump'
  WHEN pointer THEN CASE WHEN store = 'memory' AND n > 420 THEN 'content_dump' ELSE 'pointer' END WHEN vague OR n < 25 THEN 'malformed' ELSE 'preference_fact' END AS kind FROM k1)"""
_CL = "greatest({1}e0, least({2}e0, {0}))"
_B = lambda test, x: f"(CASE WHEN {test} THEN {x}e0 ELSE 0e0 END)"
_DATES = f"list_filter(list_transform(regexp_extract_all(ascii, {quoted(P.TEXT_DATE)}), lambda x: TRY_CAST(x AS DATE)), lambda x: x IS NOT NULL)"
_SCORES = (
    _KIND
    + f""", d AS (SELECT *, list_max({_DATES}) AS latest, len({_PATHS}) > 0 OR regexp_matches(ascii, '\\b[A-Z][\\w.\\-]{{2,}}\\b') OR regexp_matches(ascii, '\\d') AS concrete0 FROM k),
f AS (SELECT *, date_diff('day', latest, DATE '{TODAY}') AS age, concrete0 AS concrete FROM d),
p AS (SELECT *,
  {_CL.format("CASE WHEN kind = 'header' THEN 1e0 ELSE 0.5e0 + " + _B('preference AND NOT (temporal OR leading_date)', 0.3) + ' + ' + _B('pointer', 0.15) + ' - ' + _B('completion AND (temporal OR leading_date)', 0.4) + ' - ' + _B('metric AND NOT preference', 0.25) + ' - ' + _B('leading_date', 0.2) + ' - ' + _B("kind IN ('status_update', 'debugging_finding', 'project_progress', 'todo_temporary')", 0.2) + ' END', 0, 1)} AS durability,
  1e0 - {_CL.format("(n - ideal) / ideal * 0.5e0", 0, 0.7)} - {_B("kind = 'content_dump'", 0.3)} - {_B("kind IN ('status_update', 'debugging_finding')", 0.2)} AS fit0,
  CASE WHEN kind = 'header' THEN 1e0 WHEN pointer THEN CASE WHEN n <= CASE WHEN store = 'memory' THEN 420 ELSE 700 END THEN 1e0 ELSE 0.6e0 END WHEN kind = 'preference_fact' THEN 0.8e0 ELSE 0.2e0 END AS pointer_quality,
  {_CL.format('CASE WHEN concrete THEN 0.7e0 ELSE 0.4e0 END - ' + _B('vague', 0.3) + ' - ' + _B('n < 25', 0.2), 0, 1)} AS specificity,
  {_CL.format("CASE WHEN kind = 'header' THEN 0e0 ELSE " + _B('temporal', 0.3) + ' + ' + _B('completion AND (temporal OR leading_date OR inline_date)', 0.3) + ' + ' + _B('metric', 0.15) + " + CASE WHEN age > 30 THEN " + _CL.format('(age - 30) / 180e0 * 0.4e0 + 0.2e0', 0, 0.6) + " WHEN age IS NOT NULL AND (leading_date OR inline_date) THEN 0.1e0 ELSE 0e0 END + " + _B('volatile', 0.2) + ' - ' + _B("kind = 'preference_fact' AND NOT temporal AND NOT (leading_date OR inline_date)", 0.2) + ' END', 0, 1)} AS staleness
  FROM (SELECT *, CASE WHEN store = 'memory' THEN 200e0 ELSE 420e0 END AS ideal FROM f)),
q AS (SELECT *, {_CL.format("CASE WHEN kind IN ('header', 'pointer') THEN greatest(fit0, 0.85e0) ELSE fit0 END", 0, 1)} AS hot_memory_fit FROM p),
o AS (SELECT *, {_CL.format('0.3e0 * durability + 0.3e0 * hot_memory_fit + 0.2e0 * pointer_quality + 0.2e0 * specificity - 0.25e0 * staleness', 0, 1)} AS overall FROM q)"""
)
_AUDIT_BAG = f"list_distinct(list_concat({_bag('regexp_replace(ascii_dates, ' + quoted(P.INLINE_DATE) + ', chr(32) || chr(68) || chr(65) || chr(84) || chr(69) || chr(32), chr(103))', '[a-z][a-z0-9]{3,}', P.AUDIT_STOP + P.AUDIT_BOILERPLATE)}, list_filter(list_transform({_PATHS}, lambda p: regexp_replace(lower(p), '\\d{{4}}-\\d{{2}}-\\d{{2}}', 'DATE', 'g')), lambda p: NOT contains(p, '_archive/curator'))))"
_AUDIT_BAG = _AUDIT_BAG.replace("ascii_dates", "text")
_DUP = _SCORES + f""", b AS (SELECT ref, kind, overall, {_AUDIT_BAG} AS t FROM o WHERE kind <> 'header'),
u AS (SELECT ref, unnest(t) AS w FROM b), j AS (SELECT x.ref AS a, y.ref AS b, count(*) AS common FROM u x JOIN u y ON x.w = y.w AND x.ref < y.ref GROUP BY ALL),
dup AS (SELECT j.a, j.b, j.common, len(x.t) + len(y.t) - j.common AS either, CASE WHEN round(x.overall, 2) <= round(y.overall, 2) THEN j.a ELSE j.b END AS loser
  FROM j JOIN b x ON x.ref = j.a JOIN b y ON y.ref = j.b WHERE j.common >= 0.45e0 * (len(x.t) + len(y.t) - j.common) AND NOT (x.kind = 'pointer' AND y.kind = 'pointer'))"""
_ALL = lambda p: f"regexp_extract_all(ascii, {quoted('(?i)' + p)}, 1)"
_DEFAULTS = f"list_distinct(list_filter(list_transform(list_concat({_ALL(P.DEFAULT_IS)}, {_ALL(P.DEFAULT_NAMED)}, {_ALL(P.DEFAULT_AS)}, CASE WHEN contains(lower(text), 'default') THEN {_ALL(P.DEFAULT_TARGET)} ELSE [] END), lambda x: rtrim(lower(x), '.')), lambda x: x <> '' AND NOT list_contains({_stop(P.AUDIT_STOP)}, x)))"
_CON = f""", c AS (SELECT ref, list_distinct({_bag('text', '[a-z][a-z0-9]{3,}', P.AUDIT_STOP)}) AS t, {_DEFAULTS} AS dv, list_distinct(list_transform(regexp_extract_all(ascii, {quoted('(?i)' + P.IDENTIFIER)}), lambda x: lower(x))) AS iv, {_says(P.POLARITY_POS)} AS pos, {_says(P.POLARITY_NEG)} AS neg FROM k WHERE kind <> 'header'),
cu AS (SELECT ref, unnest(t) AS w FROM c), cj AS (SELECT x.ref AS a, y.ref AS b, count(*) AS common FROM cu x JOIN cu y ON x.w = y.w AND x.ref < y.ref GROUP BY ALL),
cp AS (SELECT cj.a, cj.b, common, len(x.t) + len(y.t) - common AS either, CASE WHEN len(x.dv) > 0 AND len(y.dv) > 0 AND NOT list_has_any(x.dv, y.dv) THEN 'default'
  WHEN common >= 0.45e0 * (len(x.t) + len(y.t) - common) AND NOT (len(x.iv) > 0 AND len(y.iv) > 0 AND NOT list_has_any(x.iv, y.iv)) AND ((x.pos AND NOT x.neg AND y.neg AND NOT y.pos) OR (x.neg AND NOT x.pos AND y.pos AND NOT y.neg)) THEN 'state' END AS reason
  FROM cj JOIN c x ON x.ref = cj.a JOIN c y ON y.ref = cj.b WHERE common >= 0.18e0 * (len(x.t) + len(y.t) - common)),
con AS (SELECT * FROM cp WHERE reason IS NOT NULL)"""
_EXT = "(" + "|".join(P.FILE_EXTENSIONS) + ")"
_FILES = f"list_filter({_PATHS}, lambda p: regexp_matches(regexp_replace(regexp_replace(p, '[).,;:`''\"]+$', ''), '/+$', ''), '(?i)\\.{_EXT}$'))"
_ACTION = _DUP + _CON + f""", act AS (SELECT ref, kind, CASE WHEN ref IN (SELECT a FROM con UNION SELECT b FROM con) THEN 'user_review' WHEN ref IN (SELECT loser FROM dup) THEN 'merge'
  WHEN kind IN ('header', 'pointer') THEN 'keep' WHEN kind = 'debugging_finding' THEN 'move_to_note'
  WHEN kind = 'status_update' THEN CASE WHEN preference THEN 'user_review' WHEN tgt OR np > 0 THEN 'archive_to_note' ELSE 'remove_after_archive' END
  WHEN kind = 'project_progress' THEN 'verify_current' WHEN kind = 'todo_temporary' THEN 'user_review'
  WHEN kind = 'content_dump' THEN CASE WHEN tgt THEN 'rewrite_to_pointer' WHEN procedure THEN 'move_to_skill' ELSE 'move_to_note' END WHEN kind = 'malformed' THEN 'user_review'
  WHEN store = 'memory' AND n > 350 THEN CASE WHEN preference THEN CASE WHEN tgt THEN 'rewrite_to_pointer' ELSE 'user_review' END ELSE 'move_to_note' END
  WHEN volatile AND (inline_date OR temporal) THEN 'verify_current' ELSE 'keep' END AS action
  FROM (SELECT *, sigil OR len({_FILES}) > 0 AS tgt, len({_PATHS}) AS np FROM o))"""
_SC = lambda c: f"CAST(floor({c} * 10000e0 + 0.5e0) AS BIGINT) AS {c}"
_KEY = f"""CASE WHEN hdr THEN 'notes-system-header' WHEN topic <> '' AND NOT list_contains({_stop(P.FACT_GENERIC)}, {_slug('topic')}) THEN {_slug('topic')} WHEN len(said) > 0 THEN {_slug("array_to_string(said, ' ')")} ELSE {_slug('base')} END"""
def _keys(src, to):
    """Common table expressions that end in `to`: the entries of `src` with key, hash and tokens."""
    return f"""{to}0 AS (SELECT *, starts_with({_STRIP.format('text')}, '↪') AS ptr, starts_with({_STRIP.format('text')}, 'Long-form notes live in') AS hdr FROM {src}),
{to}1 AS (SELECT *, CASE WHEN ptr THEN {_STRIP.format("regexp_replace(regexp_replace(" + _STRIP.format("substr(" + _STRIP.format('text') + ", 2)") + ", '(?s)\\s*→\\s*archived\\b.*$', ''), '[ .…]+$', '')")} ELSE {_FIRST.format('text')} END AS base FROM {to}0),
{to}2 AS (SELECT *, regexp_extract(base, '^([A-Za-z][\\pL\\pN_ &/+.\\-]{{1,46}}?)\\s*(?:\\([^)]*\\))?\\s*:', 1) AS topic, {_bag('base', '[A-Za-z][A-Za-z0-9]{2,}', P.FACT_STOP)}[1:6] AS said FROM {to}1),
{to} AS (SELECT ref, store, text, ptr, {_KEY} AS fact_key, substr(sha256({_STRIP.format('text')}), 1, 16) AS hash, list_distinct({_bag('text', '[A-Za-z][A-Za-z0-9]{2,}', P.FACT_STOP)}) AS t FROM {to}2)"""


_KEYS = _E + ", " + _keys("e", "keys")
_BOTH = _KEYS + ", " + ALTERED_SQL + ", " + _keys("e2", "others")
_KNOWN = _BOTH + ", kn AS (SELECT store, fact_key, arg_min(hash, ref) AS hash, arg_min(t, ref) AS t, arg_min(text, ref) AS content FROM others GROUP BY ALL)"
_MATCH = _KNOWN + """, h AS (SELECT store, hash, min(fact_key) AS hash_key FROM kn GROUP BY ALL),
j AS (SELECT x.ref, y.fact_key, count(*) AS common FROM (SELECT ref, store, unnest(t) AS w FROM keys WHERE NOT ptr) x JOIN (SELECT store, fact_key, unnest(t) AS w FROM kn) y ON x.w = y.w AND x.store = y.store GROUP BY ALL),
f0 AS (SELECT j.ref, j.fact_key, CAST(common AS DOUBLE) / (len(c.t) + len(kn.t) - common) AS sim FROM j JOIN keys c ON c.ref = j.ref JOIN kn ON kn.fact_key = j.fact_key AND kn.store = c.store),
f AS (SELECT ref, fact_key FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY sim DESC, fact_key) AS n FROM f0 WHERE sim >= 0.6e0) WHERE n = 1),
mt AS (SELECT c.ref, c.store, c.text, c.hash, CASE WHEN hash_key IS NOT NULL THEN 'DUPLICATE' WHEN kn.fact_key IS NOT NULL OR f.fact_key IS NOT NULL THEN 'UPDATE' ELSE 'NEW' END AS decision,
  CASE WHEN hash_key IS NOT NULL THEN 'hash' WHEN kn.fact_key IS NOT NULL THEN 'key' WHEN f.fact_key IS NOT NULL THEN 'fuzzy' END AS how, coalesce(hash_key, kn.fact_key, f.fact_key, c.fact_key) AS fact_key
  FROM keys c LEFT JOIN h ON c.hash = h.hash AND c.store = h.store LEFT JOIN kn ON kn.fact_key = c.fact_key AND kn.store = c.store LEFT JOIN f ON f.ref = c.ref)"""
_TOPICS = _E + f""", t0 AS (SELECT ref, {_STRIP.format('text')} AS t FROM e), t1 AS (SELECT ref, t AS t0, string_split(CASE WHEN starts_with(t, '↪') THEN {_STRIP.format('substr(t, 2)')} ELSE t END, chr(10))[1] AS head FROM t0),
topics AS (SELECT ref, t0, CASE WHEN contains(substr(head, 1, 70), ':') THEN string_split(head, ':')[1] ELSE substr(head, 1, 70) END AS topic FROM t1)"""
_RED = "html"
for _p in P.SECRETS:
    _RED = f"regexp_replace({_RED}, {quoted(_p)}, '[REDACTED]', 'g')"
_RL = _FIRST.format("text")
for _p in P.SECRETS:
    _RL = f"regexp_replace({_RL}, {quoted(_p)}, '[REDACTED]', 'g')"
_GB = f"list_distinct(list_concat({_bag('text', '[a-z][a-z0-9]{3,}', P.GATE_STOP)}, list_transform(regexp_extract_all(text, '~?/[\\w./-]+'), lambda x: lower(x))))"
_NEAR = _E + f""", l AS (SELECT item_id AS id, {_GB} AS t FROM benchmark), r AS (SELECT ref AS id, {_GB} AS t FROM e),
m AS (SELECT x.id, y.id AS best_id, count(*) AS common FROM (SELECT id, unnest(t) AS w FROM l) x JOIN (SELECT id, unnest(t) AS w FROM r) y ON x.w = y.w GROUP BY ALL),
g AS (SELECT m.*, len(l.t) AS n, len(l.t) + len(r.t) - common AS either FROM m JOIN l ON l.id = m.id JOIN r ON r.id = m.best_id)"""

SQL = {
    "content_hash": _E + f" SELECT ref, substr(sha256({_STRIP.format('text')}), 1, 16) AS content_hash FROM e",
    "slug": _E + f" SELECT ref, {_slug('text')} AS slug, {_FIRST.format('text')} AS first_line FROM e",
    "derive_key": _KEYS + " SELECT ref, fact_key FROM keys",
    "topic_of": _TOPICS + " SELECT ref, topic, starts_with(t0, '↪') AS is_pointer, starts_with(t0, 'Long-form notes live in') AS is_header FROM topics",
    "est_tokens": "SELECT doc_id, CAST((length(text) + 3) // 4 AS INTEGER) AS tokens, CAST((length(text) + 3) // 4 + 1 AS INTEGER) AS weight FROM documents",
    "extract_paths": _E + f" SELECT ref, array_to_string(list_filter(list_transform({_PATHS}, lambda p: regexp_replace(p, '[).,;:`''\"]+$', '')), lambda p: p <> ''), '|') AS paths, len({_FILES}) AS files FROM e",
    "latest_date": _E + _A + f" SELECT ref, CAST(list_max({_DATES}) AS VARCHAR) AS latest FROM a",
    "redact_secrets": f"SELECT page_id, sha256({_RED}) AS redacted_sha256 FROM pages",
    "clean_labels": _E + f", l AS (SELECT ref, replace(trim({_RL}, ' -*#`'), '`', '') AS s FROM e) SELECT ref, CASE WHEN length(s) > 60 THEN rtrim(substr(s, 1, 59)) || '…' ELSE s END AS label FROM l",
    "token_bags": _E + f" SELECT ref, len({_AUDIT_BAG}) AS audit, len(list_distinct({_bag('text', '[a-z][a-z0-9]{3,}', P.AUDIT_STOP)})) AS subject, len({_GB}) AS gate, len(list_distinct({_bag('text', '[A-Za-z][A-Za-z0-9]{2,}', P.FACT_STOP)})) AS fact FROM e",
    "signals": _E + _SIG + " SELECT ref, temporal, completion, metric, leading_date, inline_date, pointer, preference, reflection, todo, debug, progress, vague, volatile, activity, sigil FROM s",
    "entry_kinds": _E + _KIND + " SELECT ref, kind, n AS chars FROM k",
    "kind_counts": _E + _KIND + " SELECT store, kind, count(*) AS entries FROM k GROUP BY ALL",
    "quality_scores": _E + _SCORES + " SELECT ref, " + ", ".join(map(_SC, ("durability", "hot_memory_fit", "pointer_quality", "specificity", "staleness", "overall"))) + " FROM o",
    "near_duplicates": _E + _DUP + " SELECT a, b, common, either, CASE WHEN common >= 0.6e0 * either THEN 'strong' ELSE 'near' END AS strength FROM dup",
    "near_duplicate_classes": _E + _SCORES + f""", b AS (SELECT ref, list_sort({_AUDIT_BAG}) AS t FROM o WHERE kind <> 'header'), c AS (SELECT min(ref) AS rep, count(*) AS n, t FROM b WHERE len(t) > 0 GROUP BY t),
u AS (SELECT rep, unnest(t) AS w FROM c), j AS (SELECT x.rep AS a, y.rep AS b, count(*) AS common FROM u x JOIN u y ON x.w = y.w AND x.rep <> y.rep GROUP BY ALL),
l AS (SELECT j.a, count(*) AS near, sum(y.n) AS others FROM j JOIN c x ON x.rep = j.a JOIN c y ON y.rep = j.b WHERE j.common >= 0.45e0 * (len(x.t) + len(y.t) - j.common) GROUP BY j.a)
SELECT rep AS first, n AS members, coalesce(near, 0) AS near, CAST(n * (n - 1) // 2 + n * coalesce(others, 0) AS BIGINT) AS pairs FROM c LEFT JOIN l ON l.a = c.rep""",
    "best_duplicate": _E + _DUP + " SELECT ref, other, common, either FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY CAST(common AS DOUBLE) / either DESC, other) AS n FROM (SELECT a AS ref, b AS other, common, either FROM dup UNION ALL SELECT b, a, common, either FROM dup)) WHERE n = 1",
    "contradictions": _E + _KIND + _CON + " SELECT a, b, common, either, reason FROM con",
    "recommended_actions": _E + _ACTION + " SELECT ref, kind, action FROM act",
    "audit_summary": _E + _ACTION + " SELECT action, count(*) AS entries FROM act GROUP BY 1",
    "intake_gate": _E + _SIG + """ SELECT ref, CASE WHEN reflection OR stat OR dump THEN 'REJECT' WHEN pointer AND n <= 420 THEN 'ALLOW' WHEN preference AND NOT leading_date AND n <= 200 THEN 'ALLOW' ELSE 'REVIEW' END AS verdict,
  CASE WHEN reflection THEN 'dream_reflection' WHEN stat THEN 'status_update' WHEN dump THEN 'detailed_knowledge' WHEN pointer AND n <= 420 THEN 'pointer' WHEN preference AND NOT leading_date THEN 'preference' WHEN n > 200 THEN 'ambiguous_long' ELSE 'ambiguous' END AS category
  FROM (SELECT *, (temporal OR leading_date) AND (completion OR metric) OR metric AND NOT pointer AS stat, n > 420 AND NOT pointer AS dump FROM s)""",
    "pin_classes": _TOPICS + f" SELECT ref, CASE WHEN {_says(P.SAFETY_PIN, 't0')} THEN 'safety' WHEN starts_with(t0, 'Long-form notes live in') THEN 'operational' WHEN {_says(P.OPERATIONAL_TOPIC, 'topic')} THEN 'operational' ELSE 'none' END AS pin FROM topics",
    "nearest_existing": _NEAR + " SELECT id, best_id, common, either FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(common AS DOUBLE) / either DESC, best_id) AS k FROM g) WHERE k = 1",
    "containment_dup": _NEAR + " SELECT id, common, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY common DESC, best_id) AS k FROM g) WHERE k = 1",
    "match_decisions": _MATCH + " SELECT ref, decision, how, fact_key FROM mt",
    "ingest": _MATCH.replace("WITH ", "WITH RECURSIVE ", 1).replace("mt AS (", "mt AS MATERIALIZED (") + """, it AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY store ORDER BY r) AS i FROM (SELECT store, fact_key, hash, min(ref) AS r FROM mt GROUP BY ALL)),
pass(store, i, names, fact_key, hash, own, place) AS (
  SELECT store, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM it GROUP BY store
  UNION ALL SELECT p.store, p.i + 1, list_append(p.names, x.own), x.fact_key, x.hash, x.own, x.place FROM pass p JOIN LATERAL (
    SELECT *, CASE WHEN place IS NULL THEN fact_key ELSE fact_key || '-' || place END AS own FROM (SELECT it.*, CASE WHEN list_contains(p.names, it.fact_key) THEN
      list_filter(range(2, 3 + len(list_filter(p.names, lambda n: starts_with(n, it.fact_key || '-')))), lambda k: NOT list_contains(p.names, it.fact_key || '-' || k))[1] END AS place FROM it WHERE it.store = p.store AND it.i = p.i + 1)) x ON true),
m2 AS (SELECT mt.ref, mt.store, mt.text, mt.hash, CASE WHEN place IS NOT NULL THEN 'NEW' ELSE decision END AS decision, own AS fact_key FROM mt JOIN pass pl ON pl.store = mt.store AND pl.fact_key = mt.fact_key AND pl.hash = mt.hash),
ar AS (SELECT fact_key, max('2024-01-' || lpad(CAST(ref % 28 + 1 AS VARCHAR), 2, '0')) AS archived_at FROM others WHERE ref % 10 = 7 GROUP BY 1),
li AS (SELECT m2.ref, m2.store, m2.fact_key, CASE WHEN kn.hash = m2.hash THEN NULL WHEN decision = 'NEW' THEN 'create' ELSE 'update' END AS op, CAST(NULL AS VARCHAR) AS archived_at FROM m2 LEFT JOIN kn ON kn.store = m2.store AND kn.fact_key = m2.fact_key),
lo AS (SELECT CAST(NULL AS BIGINT) AS ref, kn.store, kn.fact_key, CASE WHEN ar.fact_key IS NOT NULL THEN 'archive' ELSE 'delete' END AS op, archived_at FROM kn LEFT JOIN ar ON ar.fact_key = kn.fact_key WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2.store = kn.store AND m2.fact_key = kn.fact_key))
SELECT store, coalesce(op, 'none') AS op, fact_key, archived_at, ref FROM (SELECT store, op, fact_key, archived_at, ref FROM li UNION ALL SELECT store, op, fact_key, archived_at, ref FROM lo)""",
}
