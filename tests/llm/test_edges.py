"""Each operator and pipeline stage with clashing names, a map column, nulls, a very long text, repeated rows, ties and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import pii
from palimpsest.llm.ann import nearest
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.line_dedup import line_dedup
from palimpsest.llm.mixing import mix
from palimpsest.llm.ngram_join import ngram_join
from palimpsest.llm.queries import MODEL
from palimpsest.llm.quality import score_quality
from palimpsest.llm.sentencepiece_codec import encode
from palimpsest.llm.url_filter import filter_urls
from palimpsest.llm.warc import round_trip

#: Columns that the operators make on their way, and their results' names.
NAMES = (
    "id t1 t2 pos key k1 k2 lost_id dropped n_lines n_dropped h1 h2 won u_digest u_short r_digest r_short r_rule r_path r_verdict host path rule verdict fit row row2 body "
    "spans base_spans m1 m2 terms entity term holds hits d1 d2 d_size d_total d_target d_copies size source_size target copies taken coin frac mass chunk extra "
    "token set one two grp n near_id near_key stays component component_id links at v q shard block of reach query_id rank score held_out predicted l_id hashed f0 f1 "
    "token_ids decoded content digest salt best keep_id keep_n group_size kept text_sha256 payload first_id copies_ record_type refers_to claimed"
).split()


def words(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "ann@x.org", "1.2.3.4", "omega"]) + str(r.randrange(9)) for _ in range(n))


def rows_of():
    r = random.Random(5)
    base = [(i, words(r, r.randint(1, 30)), "en", r.choice(["s1", "s2", None]), 0) for i in range(30)]
    long = "\n".join(words(r, 60) for _ in range(400))
    return [*base, base[3], base[3], (None, base[4][1], None, None, None), (None, None, None, None, None), (90, None, "en", "s1", None), (91, "", "", "", 0), (92, " \n\t", "en", "s1", 3), (93, long, "en", "s2", len(long)), (94, long, "en", "s2", len(long)), (95, "x" * 300_000, "en", "s1", 0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def crowded(df):
    """With a column for every internal name that df hasn't, and a map."""
    for i, n in enumerate(n for n in NAMES if n not in df.columns):
        df = df.withColumn(n, F.lit(f"own {i}"))
    return df.withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame(rows_of(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(90, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return spark.read.parquet(f"{at}/documents.parquet"), at


DOCUMENT_OPERATORS = {
    "line_dedup": lambda d, at: line_dedup(d),
    "find_pii": lambda d, at: pii.find_pii(d),
    "mix": lambda d, at: mix(d),
    "score_quality": lambda d, at: score_quality(d, d.sparkSession.read.parquet(f"{at}/labels.parquet")),
    "encode": lambda d, at: encode(d, MODEL),
    "exact_dedup": lambda d, at: exact_dedup(d),
    "ngram_join": lambda d, at: ngram_join(d),
    "filter_urls": lambda d, at: filter_urls(d, d.sparkSession.sql("SELECT * FROM VALUES ('com', '/', 'block') AS r(host, path, verdict)"), url="text"),
}


def told(df, cols):
    return Counter(tuple(str(x) for x in r) for r in df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).collect())


@pytest.mark.parametrize("name", sorted(DOCUMENT_OPERATORS))
def test_clashing_names_change_nothing(spark, documents, name):
    docs, at = documents
    op, wide = DOCUMENT_OPERATORS[name], crowded(docs)
    plain, out = op(docs, at), op(wide, at)
    alone = name in ("exact_dedup", "ngram_join")
    new = plain.columns if alone else plain.columns[len(docs.columns) :]
    own = out.columns if alone else out.columns[len(wide.columns) :]
    carried = [] if alone else [c for c in wide.columns if c not in ("tags", "text")]
    assert len(own) == len(new) and (alone or out.columns[: len(wide.columns)] == wide.columns)
    got = told(out, ["doc_id", *own, *carried])
    assert Counter({k[: len(own) + 1]: n for k, n in got.items()}) == told(plain, ["doc_id", *new]) if alone else sum(got.values()) == len(rows_of())
    if not alone:
        want = told(plain, ["doc_id", *new])
        short = Counter()
        for k, n in got.items():
            short[k[: len(own) + 1]] += n
        assert short == want
        assert all(k[len(own) + 1 :][i] == f"own {j}" for k in got for j, c in enumerate(n for n in NAMES if n not in docs.columns) for i in [carried.index(c)])
    assert op(wide.limit(0), at).count() == 0


def test_clashing_names_of_vectors_and_pages(spark):
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(7, [1.0] * 8), (7, [1.0] * 8), (None, [2.0] * 8), (300, None), (301, [0.0] * 8)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    extra = [n for n in NAMES if n not in ("v", "q")]
    wide = v.select("*", *[F.lit("own").alias(n) for n in extra], F.create_map(F.lit("a"), F.lit(1)).alias("tags"), F.lit(1).alias("v"), F.lit(2).alias("q"))
    plain = lambda df: sorted(map(tuple, nearest(df, F.col("vec_id") % 10 == 0).collect()))
    got = plain(v)
    assert plain(wide) == got and len(got) == 12 * 5
    assert nearest(wide.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    pages = [(i, f"http://h/{i}", f"page {i % 4} " * 40) for i in range(12)] + [(None, None, None), (3, "u", "page 3 " * 40), (50, "u", "z" * 2_000_000)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    wide = p.select("*", *[F.lit("own").alias(n) for n in NAMES], F.create_map(F.lit("a"), F.lit(1)).alias("tags"))
    read = lambda df: sorted(map(str, round_trip(df).collect()))
    got = read(p)
    assert read(wide) == got and len(got) == len(pages)
    assert round_trip(wide.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, documents, name, stage):
    """Stages keep the columns of what they get, whatever these are, and stand nulls, repeats, long texts and empty tables."""
    docs, at = documents
    wide = crowded(docs)
    out = stage(spark, wide, at)
    if name == corpus_pipeline.STAGES[-1][0]:
        assert [r.round_trip for r in out.collect()] == [True] * len(rows_of())
    else:
        assert out.columns == wide.columns
        found = out.select(*docs.columns, "tags", "near_id").collect()
        assert found and {(r.tags["a"], r.near_id) for r in found} == {(1, f"own {[n for n in NAMES if n not in docs.columns].index('near_id')}")}
        ids = {r[0] for r in rows_of()}
        assert {r.doc_id for r in found} <= ids
        if name.startswith("line"):
            assert len(found) == len(rows_of()) and all(r.n_chars == len(r.text) for r in found)
        if name.startswith("n-gram"):
            assert len([r for r in found if r.doc_id in (93, 94)]) == 1 and {90, 91, 92} <= {r.doc_id for r in found} and len([r for r in found if r.doc_id == 3]) == 1
        if name.startswith("mixing"):
            assert not {90, 91, 92} & {r.doc_id for r in found}
    assert stage(spark, wide.limit(0), at).count() == 0
