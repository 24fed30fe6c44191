"""Queries of retrieval and projection. Scores are compared as whole ten-thousandths or millionths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BUDGET, SEMANTIC_COSINE
from ..functions import patterns as P
from ..functions import text as X
from ..functions.shared import stored
from ..operators import audit as A
from ..operators import gate as G
from ..operators import projection as J
from ..operators import retrieval as R
from ..operators import similarity as S
from .bind import TODAY, entries, table
from .text_queries import _E, _GB, _SCORES, _STRIP, _TOPICS, _says

K, PROFILE = 10, 50


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(spark, d):
    """The stated query set: every vector whose id is divisible by 20, against all."""
    return _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def _mil(c, name):
    return F.round(c * 1000000).cast("long").alias(name)


def _hundredths(c):
    return X.rounded(c, 2)


def vector_topk(spark, d):
    return R.vector_topk(_vectors(spark, d), _asked(spark, d), K).select("query_id", "id", "rank", _mil(F.col("score"), "score"))


def vector_topk_filtered(spark, d):
    return R.vector_topk(_vectors(spark, d), _asked(spark, d), K, F.col("label") == 3).select("query_id", "id", "rank", _mil(F.col("score"), "score"))


def _tokens(spark, d):
    docs = entries(spark, d).select(F.col("ref").alias("id"), X.gate_tokens(F.col("text")).alias("tokens"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), X.gate_tokens(F.col("text")).alias("tokens"))
    return docs, items


def _lexical(spark, d, most=20):
    """The best of the relevance of whole documents to benchmark items, with the place by the rounded score, then by the text's hash, then by id."""
    docs, items = _tokens(spark, d)
    hashes = entries(spark, d).select(F.col("ref").alias("id"), X.content_hash(F.col("text")).alias("hash"))
    return R.ranked_relevance(R.lexical_relevance(docs, items), hashes, most)


def lexical_idf_topk(spark, d):
    return _lexical(spark, d).select("query_id", "id", "rank", F.round(F.col("score") * 1e4).cast("long").alias("score"))


def hybrid_rrf(spark, d):
    """Vector and keyword lists fused: query 20 i asks with its vector and with the words of benchmark item i, where there is one."""
    from pyspark.sql import Window

    sem = R.vector_topk(_vectors(spark, d), _asked(spark, d), 20).select("query_id", F.lit("semantic").alias("list"), "id", (F.col("rank") - 1).alias("pos"))
    kw = _lexical(spark, d).withColumn("query_id", F.col("query_id") * 20).join(_asked(spark, d).select("query_id"), "query_id", "left_semi")
    fused = R.fuse(sem.unionByName(kw.select("query_id", F.lit("keyword").alias("list"), "id", (F.col("rank") - 1).alias("pos"))))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("score") * 1e9)), "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K).select("query_id", "id", "rank", "source", F.round(F.col("score") * 1e9).cast("long").alias("score"))


def semantic_duplicates(spark, d):
    """Entries whose bags pass the prefilter and whose vectors are close; an entry's vector is the one of its number."""
    v = _vectors(spark, d)
    # a pair needs both vectors, so entries without one meet nobody
    e = entries(spark, d).join(v.select(F.col("id").alias("ref")), "ref", "left_semi").select(F.col("ref").alias("id"), X.gate_tokens(F.col("text")).alias("tokens"))
    pairs = S.similar_pairs(e, 0.30).where(F.col("common") > 0.30 * F.col("either"))
    x, y = v.select((F.col("id")).alias("a"), F.col("vector").alias("va")), v.select((F.col("id")).alias("b"), F.col("vector").alias("vb"))
    met = pairs.join(x, "a").join(y, "b").withColumn("cosine", X.vector_cosine(F.col("va"), F.col("vb")))
    return met.select("a", "b", (F.col("common") >= 0.45 * F.col("either")).alias("token_flagged"), (F.col("cosine") >= SEMANTIC_COSINE).alias("semantic"), _mil(F.col("cosine"), "cosine"))


def recency_scores(spark, d):
    e = entries(spark, d)
    day = X.latest_date(F.col("text"))
    return e.select("ref", F.when(day.isNull(), "neutral-default").otherwise("text-date").alias("source"), _mil(J.recency(day, F.lit(TODAY).cast("date")), "recency"))


def _scored(spark, d):
    """Entries of profiles of fifty each with score, pin and relevance (the share that an entry holds of the query of the profile's number)."""
    a = A.audit(entries(spark, d), F.lit(TODAY).cast("date"))
    e, q = _tokens(spark, d)
    rel = R.lexical_relevance(e.withColumn("query_id", F.floor(F.col("id") / PROFILE).cast("long")), q).select(F.col("query_id").alias("grp"), F.col("id").alias("ref"), F.col("score").alias("relevance"))
    # what the score takes from a text is made before the join, which moves no text
    t, sc = F.col("text"), F.col("scores")
    parts = a.select(
        F.floor(F.col("ref") / PROFILE).cast("long").alias("grp"), "ref", X.entry_weight(t).alias("tokens"), (G.pin_class(t) != "none").alias("pinned"), X.clamp((sc["durability"] + sc["pointer_quality"]) / 2.0).alias("importance"),
        X.latest_date(t).alias("day"), sc["specificity"].alias("specificity"), sc["hot_memory_fit"].alias("fit"),
    )
    s = parts.join(rel, ["grp", "ref"], "left").withColumn("relevance", X.rounded(F.coalesce("relevance", F.lit(0.0)), 4))
    score = J.projection_score(F.col("importance"), J.recency(F.col("day"), F.lit(TODAY).cast("date")), F.col("specificity"), F.col("fit"), F.col("pinned"), F.col("relevance"))
    return s.select("grp", F.col("ref").alias("ord"), "ref", "tokens", "pinned", X.rounded(score, 4).alias("score"), "relevance")


def projection_scores(spark, d):
    return _scored(spark, d).select("grp", "ref", "tokens", "pinned", F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score"))


def reserve_fill(spark, d):
    s = stored(_scored(spark, d), "scored").where(~F.col("pinned")).withColumn("relevance", _hundredths(F.col("relevance"))).withColumn("score", F.lit(0.0))
    return J.reserve(s.withColumn("room", F.lit(BUDGET)), least=0.05).select("grp", "ref", "used")


def projection(spark, d):
    p = J.project(stored(_scored(spark, d), "scored"), BUDGET)
    return p.groupBy("grp").agg(F.count("*").alias("entries"), F.count_if("selected").alias("selected"), F.sum(F.when(F.col("selected"), F.col("tokens"))).alias("tokens"), F.count_if(F.col("how") == "pin").alias("pinned"), F.count_if(F.col("how") == "reserve").alias("reserved"))


def knapsack_selection(spark, d):
    """Best value of each eight entries in a row within the budget; the oracle tries every subset."""
    e = entries(spark, d).select(F.floor(F.col("ref") / 8).alias("grp"), F.col("ref").alias("ord"), "ref", X.entry_weight(F.col("text")).alias("tokens"), ((F.col("ref") * 37 % 101 + 1) / 128.0).alias("score"), F.lit(BUDGET).alias("room"))
    return J.knapsack(e).groupBy("grp").agg(F.sum(F.round(F.col("score") * 128).cast("long")).alias("value"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, lexical_idf_topk, hybrid_rrf, semantic_duplicates, recency_scores, projection_scores, reserve_fill, projection, knapsack_selection)}

_VEC = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings), q AS (SELECT id AS query_id, label, vec AS qv FROM v WHERE id % 20 = 0),
sim AS (SELECT query_id, id, v.label, list_cosine_similarity(vec, qv) AS score FROM v, q)"""
_TOP = "SELECT query_id, id, rank, CAST(round(score * 1000000) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sim{}) WHERE rank <= 10"
_LEX = _E + f""", d AS (SELECT ref AS id, {_GB} AS t FROM e), bq AS (SELECT item_id AS query_id, {_GB} AS t FROM benchmark), w AS (SELECT id, unnest(t) AS tok FROM d), df AS (SELECT tok, count(*) AS df FROM w GROUP BY 1),
ask AS (SELECT query_id, tok, CASE WHEN df IS NULL THEN ln(1e0 + (SELECT count(*) FROM d)) ELSE ln(1e0 + (SELECT count(*) FROM d) / CAST(df AS DOUBLE)) END AS wt FROM (SELECT query_id, unnest(t) AS tok FROM bq) LEFT JOIN df USING (tok)),
lex AS (SELECT h.query_id, h.id, held / whole AS score FROM (SELECT query_id, id, sum(wt) AS held FROM w JOIN ask USING (tok) GROUP BY ALL) h JOIN (SELECT query_id, sum(wt) AS whole FROM ask GROUP BY 1) t ON h.query_id = t.query_id),
lr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, substr(sha256({_STRIP.format("text")}), 1, 16), id) AS rank FROM (SELECT query_id, id, round(least(1e0, score), 4) AS score FROM lex) JOIN e ON e.ref = id)"""
_RESERVE = _LEX + f""", pins AS (SELECT ref, {_says(P.SAFETY_PIN, 't0')} OR starts_with(t0, 'Long-form notes live in') OR {_says(P.OPERATIONAL_TOPIC, 'topic')} AS pinned FROM ({_TOPICS} SELECT * FROM topics)),
c AS (SELECT e.ref // 50 AS grp, e.ref, CAST((length(text) + 3) // 4 + 1 AS INTEGER) AS tokens, round(round(coalesce(score, 0), 4), 2) AS rel FROM e JOIN pins ON pins.ref = e.ref LEFT JOIN lex ON lex.id = e.ref AND lex.query_id = e.ref // 50 WHERE NOT pinned),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rel DESC, ref) AS n FROM c WHERE rel >= 0.05),
f AS (WITH RECURSIVE s(grp, n, used, k, ref) AS (SELECT DISTINCT grp, CAST(0 AS BIGINT), 0, 0, CAST(NULL AS BIGINT) FROM r UNION ALL
  SELECT s.grp, s.n + 1, CASE WHEN s.k < 3 AND s.used + r.tokens <= 2000 THEN s.used + r.tokens ELSE s.used END, CASE WHEN s.k < 3 AND s.used + r.tokens <= 2000 THEN s.k + 1 ELSE s.k END, CASE WHEN s.k < 3 AND s.used + r.tokens <= 2000 THEN r.ref END FROM s JOIN r ON r.grp = s.grp AND r.n = s.n + 1) SELECT * FROM s)
SELECT grp, ref, max(used) OVER (PARTITION BY grp) AS used FROM f WHERE ref IS NOT NULL"""

SQL = {
    "vector_topk": "WITH " + _VEC + _TOP.format(""),
    "vector_topk_filtered": "WITH " + _VEC + _TOP.format(" WHERE label = 3"),
    "lexical_idf_topk": _LEX + " SELECT query_id, id, rank, CAST(round(score * 1e4) AS BIGINT) AS score FROM lr WHERE rank <= 20",
    "hybrid_rrf": _LEX + ", " + _VEC + """, l AS (SELECT query_id, 'semantic' AS list, id, rank - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sim) WHERE rank <= 20
  UNION ALL SELECT query_id * 20, 'keyword', id, rank - 1 FROM lr WHERE rank <= 20 AND query_id * 20 IN (SELECT query_id FROM q)),
f AS (SELECT query_id, id, CAST(round(sum(1e0 / (61 + pos)) * 1e9) AS BIGINT) AS score, CASE WHEN count(*) = 2 THEN 'both' ELSE min(list) END AS source FROM l GROUP BY ALL)
SELECT query_id, id, rank, source, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""",
    "semantic_duplicates": _E + f""", d AS (SELECT ref AS id, {_GB} AS t FROM e), w AS (SELECT id, unnest(t) AS tok FROM d), j AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM w x JOIN w y ON x.tok = y.tok AND x.id < y.id GROUP BY ALL),
p AS (SELECT a, b, c, len(x.t) + len(y.t) - c AS u FROM j JOIN d x ON x.id = a JOIN d y ON y.id = b WHERE c > 0.3e0 * (len(x.t) + len(y.t) - c)), v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)
SELECT a, b, c >= 0.45e0 * u AS token_flagged, list_cosine_similarity(x.vec, y.vec) >= 0.85e0 AS semantic, CAST(round(list_cosine_similarity(x.vec, y.vec) * 1000000) AS BIGINT) AS cosine FROM p JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b""",
    "recency_scores": _E + _SCORES + " SELECT ref, CASE WHEN latest IS NULL THEN 'neutral-default' ELSE 'text-date' END AS source, CAST(round(CASE WHEN latest IS NULL THEN 0.5e0 ELSE least(1e0, pow(0.5e0, greatest(age, 0) / 30e0)) END * 1000000) AS BIGINT) AS recency FROM o",
    "projection_scores": f"""SELECT ref // 50 AS grp, ref, tokens, pinned, CAST(floor(round(greatest(0e0, least(1e0, 0.25e0 * greatest(0e0, least(1e0, (durability + pointer_quality) / 2e0)) + 0.15e0 * rec + 0.15e0 * specificity + 0.1e0 * hot_memory_fit + CASE WHEN pinned THEN 0.15e0 ELSE 0e0 END + 0.2e0 * rel)), 4) * 1000 + 0.5e0) AS BIGINT) AS score
FROM (SELECT x.*, z.pinned, round(coalesce(y.score, 0e0), 4) AS rel FROM ({_E}{_SCORES} SELECT ref, CAST((n + 3) // 4 + 1 AS INTEGER) AS tokens, durability, pointer_quality, specificity, hot_memory_fit, CASE WHEN latest IS NULL THEN 0.5e0 ELSE least(1e0, pow(0.5e0, greatest(age, 0) / 30e0)) END AS rec FROM o) x
JOIN ({_TOPICS} SELECT ref, {_says(P.SAFETY_PIN, 't0')} OR starts_with(t0, 'Long-form notes live in') OR {_says(P.OPERATIONAL_TOPIC, 'topic')} AS pinned FROM topics) z USING (ref) LEFT JOIN ({_LEX} SELECT query_id, id, score FROM lex) y ON y.id = x.ref AND y.query_id = x.ref // 50)""",
    "reserve_fill": _RESERVE,
    "knapsack_selection": _E + f""", i AS (SELECT ref // 8 AS grp, ref % 8 AS bit, (length(text) + 3) // 4 + 1 AS w, ref * 37 % 101 + 1 AS val FROM e),
s AS (SELECT grp, m, coalesce(sum(w) FILTER ((m >> bit) & 1 = 1), 0) AS w, coalesce(sum(val) FILTER ((m >> bit) & 1 = 1), 0) AS val FROM i, range(256) t(m) GROUP BY ALL) SELECT grp, CAST(max(val) AS BIGINT) AS value FROM s WHERE w <= {BUDGET} GROUP BY 1 HAVING max(val) > 0""",
}
