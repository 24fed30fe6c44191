"""One thin query per corpus operator over whole tables, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii
from .ann import nearest
from .common import table, text_of
from .exact_dedup import exact_dedup
from .hard_negatives import mine
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import ngram_join
from .quality import score_quality
from .sentencepiece_codec import encode
from .token_files import read_tokens, write_tokens
from .url_filter import filter_urls
from .vector_codes import compress
from .warc import round_trip

#: The tokenizer files that the queries use.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORDS = "/opt/tokenizers/word_bpe_49k.json"

#: Fixed rules: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # literals: Spark knows their size, and no Python worker reads them
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " AS r(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of ids, the SHA-256 of the comma-joined ids, and whether decoding gives the text back."""
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), MODEL)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"), (F.col("decoded") == text_of("text")).alias("round_trip"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base_spans", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]  # noqa: B023
    return out.select("doc_id", *counts, F.sha2(pii.joined(F.col("base_spans")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), WORDS))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("vec_id") % 100 == 0)


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5_pii that SQL can express: the base spans."""
    return op5_pii(spark, sf_dir).drop("spans")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_mixing that SQL can express: sizes and targets."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_sentencepiece, op4_ngram_join, op5_pii, op6_mixing, op7_ann, op8_warc, op9_exact_dedup, op10_quality, op11_token_files, op12_vector_codes, op13_hard_negatives, pii_base, mixing_targets)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^ \\t\\n\\x0B\\f\\r]+')"
_SPANS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INTEGER) > 255)) = 0"),
    "card": (
        r"[0-9](?:[ -]?[0-9])+",
        "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INTEGER) "
        "ELSE (2 * CAST(substr(d, i, 1) AS INTEGER)) % 10 + CAST(CAST(substr(d, i, 1) AS INTEGER) >= 5 AS INTEGER) END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
}
_PII = "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), " + ", ".join(
    f"m{r} AS (SELECT doc_id, {r} AS r, '{k}' AS kind, v, CAST(list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS s "
    f"FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, string_split_regex(text, '{p}') AS parts, ms, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS v "
    f"FROM (SELECT *, regexp_extract_all(text, '{p}') AS ms FROM t) WHERE len(ms) > 0)) WHERE {ok})"
    for r, (k, (p, ok)) in enumerate(_SPANS.items())
)
_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
# Of vectors cut into 4 parts: assignments a0 to a4, each by the codebook before it, and codebooks c0 to c4.
_CODES = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, CAST(len(embedding) / 4 AS BIGINT) AS w FROM embeddings WHERE {_SOUND}),
x AS MATERIALIZED (SELECT vec_id, label, p, q[p * w + 1:(p + 1) * w] AS v FROM kept, range(4) r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))""" + "".join(
    f""",
a{r} AS MATERIALIZED (SELECT vec_id, label, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.*, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{r} c ON c.p = x.p) GROUP BY ALL)""" + (
        f""",
m{r} AS (SELECT p, e, i, CAST(floor(sum(v[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM a{r}, range(1, (SELECT min(w) FROM kept) + 1) t(i) GROUP BY p, e, i),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS v FROM m{r} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)""" if r < 4 else "")
    for r in range(5)
)
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op1_line_dedup": f"""
WITH l AS (
  SELECT doc_id, pos, parts[pos] AS line, trim({_LOWER.format('parts[pos]')}, {_WS}) AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), common AS (
  SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), d AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AS dropped FROM l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id""",
    "op2_url_filter": f"""
WITH r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT u.page_id, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC) AS n
      FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.n = 1""",
    "op4_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
j AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM j UNION ALL SELECT b, a FROM j),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY 1) c ON c.x = s.doc_id""",
    "pii_base": _PII + ", a AS (" + " UNION ALL ".join(f"SELECT doc_id, r, kind, s, s + length(v) AS e FROM m{r}" for r in range(len(_SPANS))) + ") SELECT t.doc_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _SPANS) + ", sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r), '')) AS base_sha256 FROM t LEFT JOIN a ON a.doc_id = t.doc_id GROUP BY t.doc_id",
    "mixing_targets": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source IS NULL, source) AS pos FROM d GROUP BY 1),
w AS (SELECT *, [3e0, 1e0, 2e0][(pos - 1) % 3 + 1] AS weight, 2e0 * total AS room, (SELECT 1.5e0 * sum(total) FROM s) AS pool FROM s),
k AS (SELECT *, (pool - coalesce(sum(room) OVER (ORDER BY room / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY room / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT arg_min(level, room / weight) AS level FROM k WHERE level * weight <= room)
SELECT doc_id, size, total AS source_size, round(least(room, v.level * weight), 3) AS target FROM d JOIN w ON w.source IS NOT DISTINCT FROM d.source, v""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""",
    "op9_exact_dedup": f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), {_WS}, '') AS t FROM documents),
k AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k""",
    "op12_vector_codes": f"""{_CODES},
o AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(v, ',') AS t FROM c4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o, h""",
    "op13_hard_negatives": f"""
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE label IS NOT NULL AND {_SOUND}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10""",
}
