"""The corpus queries against SQL, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm.queries import QUERIES, SQL

from ..conftest import SF, rows_of


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def rows(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_ngram_join_query(spark):
    from .test_operators import shingles

    docs = [(r["doc_id"], shingles(r["text"])) for r in rows("documents")]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, x) in enumerate(docs):
        for j, y in docs[:k]:
            if x and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op4_ngram_join"](spark, SF).collect()} == {(i, len(x), root(i)) for i, x in docs}


def test_pii_query(spark):
    from .test_operators import plain_spans, sha

    got = {r.doc_id: r for r in QUERIES["op5_pii"](spark, SF).collect()}
    for r in rows("documents"):
        want, out = plain_spans(r["text"]), got[r["doc_id"]]
        assert [out.n_email, out.n_ip, out.n_card, out.n_phone] == [sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone")]
        told = [f"{k}:{s}:{e}" for k, s, e in want]
        assert out.base_sha256 == sha(",".join(told))
        every = out.spans.split(",") if out.spans else []
        assert [x for x in every if not x.startswith("term:")] == told and [int(x.split(":")[1]) for x in every] == sorted(int(x.split(":")[1]) for x in every)


def test_mixing_query(spark):
    import re
    from collections import Counter

    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows("documents")}
    of = {r["doc_id"]: r["source"] for r in rows("documents")}
    total, taken, target = Counter(), Counter(), {}
    for i, s in of.items():
        total[s] += size[i]
    for r in QUERIES["op6_mixing"](spark, SF).collect():
        assert r.size == size[r.doc_id] and r.source_size == total[of[r.doc_id]] and r.taken in (0, r.size, 2 * r.size)
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3 and all(abs(taken[s] - t) <= max(size.values()) and t <= 2 * total[s] + 1e-6 for s, t in target.items())


def test_nearest_query_on_the_given_vectors(spark):
    """Recall against exact search, and the share of vectors that a query scores."""
    import numpy as np

    from palimpsest.llm.ann import searched

    for at, most in (("/root/testdata/sf0.01", 0.75), ("/root/testdata/sf0.1", 0.65)):
        v = spark.read.parquet(f"{at}/embeddings.parquet")
        found, told = searched(v, F.col("vec_id") % 50 == 0)
        t = v.orderBy("vec_id").toPandas()
        x, ids = np.stack(t.embedding.values).astype(np.float64), t.vec_id.values
        unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        hits = 0
        for k in np.flatnonzero(ids % 50 == 0):
            s = unit @ unit[k]
            s[k] = -9
            hits += len(set(ids[np.argsort(-s)[:5]]) & set(got[ids[k]]))
        total = told.agg(F.sum(F.col("scored")) / F.sum(F.col("queries") * F.col("rows"))).first()[0]
        assert hits >= 0.9 * 5 * len(got) and total <= most, (at, hits / 5 / len(got), total)


def test_sentencepiece_query(spark):
    import sentencepiece

    from palimpsest.llm.queries import MODEL

    from .test_operators import sha

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {r["doc_id"]: sp.encode(r["text"] or "") for r in rows("documents")}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.round_trip) for r in QUERIES["op3_sentencepiece"](spark, SF).collect()} == {(i, len(x), sha(",".join(map(str, x))), True) for i, x in want.items()}


def test_quality_query_equals_its_ranking(spark):
    """The fit and the scores again in plain Python from the whole tables: the same weights, the same scores."""
    import numpy as np
    import pyarrow as pa

    from palimpsest.llm import quality as Q

    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    x, good = Q._labelled(d.select("doc_id", "text"), labels, "text", "doc_id", Q.SAMPLE)
    r = Q.fit(x, good)
    t = d.select("doc_id", "text", *[c.alias(f"s{i}") for i, c in enumerate(Q.shares(F.coalesce("text", F.lit(""))))]).toPandas()
    worth = np.column_stack([Q.hashed(pa.array(t.text, pa.string())), t[[c for c in t if c.startswith("s")]].to_numpy()]) @ r.weights
    got = {x.doc_id: x for x in QUERIES["op10_quality"](spark, SF).collect()}
    for i, w in zip(t.doc_id, worth, strict=True):
        assert abs(got[i].score - 1 / (1 + np.exp(-(w - r.cut + Q.LOGIT)))) < 1e-5 and got[i].predicted == int(got[i].score >= 0.7)
    # more good documents than bad ones stand above the cut's place among those left out of the fit, and the loss can't be lowered along any weight
    assert len(got) == len(t) and 0 < good.sum() < len(good)


def test_pipeline(spark):
    import corpus_pipeline as p
    from palimpsest.llm.quality import score_quality
    from palimpsest.llm.ngram_join import ngram_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(p.STAGES) <= 5
    seen, now = [], docs
    for name, stage in p.STAGES:
        before, now = now, stage(spark, now, SF).cache()
        seen.append(now.count())
        if name != p.STAGES[-1][0]:
            assert now.columns == docs.columns
        if name.startswith("quality"):
            kept = score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in kept.collect()}
        if name.startswith("line"):
            assert now.count() == before.count()
        if name.startswith("n-gram"):
            assert now.count() == ngram_join(before).where("doc_id = component_id").count()
            assert ngram_join(now).where("doc_id <> component_id").count() == 0
    assert now.where(~F.col("round_trip")).count() == 0
    assert p.run(spark, SF).count() == seen[-1]
