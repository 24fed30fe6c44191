"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import pii
from palimpsest.llm.ann import nearest
from palimpsest.llm.components import components
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.line_dedup import line_dedup
from palimpsest.llm.mixing import mix, pivot
from palimpsest.llm.ngram_join import ngram_join
from palimpsest.llm.quality import score_quality
from palimpsest.llm.queries import MODEL
from palimpsest.llm.sentencepiece_codec import Codec, encode
from palimpsest.llm.url_filter import filter_urls
from palimpsest.llm.warc import fetch, open_bundle, plan_records, read_bundles, read_frame, read_seek_table, round_trip, seek_table, write_bundles

DOCS = "doc_id long, text string, source string"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WS = " \t\n\x0b\x0c\r"


def lower(s):
    return s.translate(str.maketrans(UP, LOW))


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def corpus(seed, n=60):
    """Documents made of a few lines and words, with copies, near copies, nulls, blanks and a long one."""
    r = random.Random(seed)
    words = ["alpha", "Beta", "ÉTÉ", "x", "don't", "été", "日本", "a.b"]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 9)))
    lines = [line() for _ in range(8)] + ["", "  Alpha ", "\talpha"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 4))), r.choice(["s1", "s2", None])) for i in range(n)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, " \n\t", "s2"), (1003, "alpha beta " * 20_000, "s1"), (None, "alpha", "s1"), (5, rows[5][1], rows[5][2])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_dedup(spark, seed):
    rows = corpus(seed)
    norm = lambda t: re.sub(f"[{WS}]", "", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i if i is not None else 0, i))
    for digest in (None, lambda c: F.lit(b"x")):  # whole contents decide even where all digests are the same
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs(spark, rows), digest=digest).collect())
        assert got == Counter((i, min(groups[norm(t)])[3], len(groups[norm(t)]), sha(norm(t))) for i, t, _ in rows)
    assert exact_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    key = lambda l: lower(l).strip(WS)
    held = Counter(k for _, t, _ in rows for k in {key(l) for l in (t or "").split("\n")} if k)
    df = docs(spark, rows).withColumn("n_lines", F.lit("own")).withColumn("dropped", F.lit(1))
    out = line_dedup(df, min_docs=10)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "dropped", "_n_lines", "n_dropped"]
    got = Counter((r.doc_id, r.text, r._n_lines, r.n_dropped) for r in out.collect())
    want = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [l for l in lines if held[key(l)] < 10]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    assert got == want
    assert line_dedup(docs(spark, [])).count() == 0


def test_url_filter(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("a.example.com", "/en/x", "allow"), ("net", "", "block"), ("net", "/fr/", "allow")]
    urls = [None, "", "no scheme.com/", "http://", "https://EXAMPLE.com/en/", "http://b.Example.com/en/page?q=/fr/", "http://a.example.com/en/xyz#t", "x://net", "x://net/fr/", "x://notnet/", "http://com/en/", "http://user@example.com:80/en/", "s://a://b.net/fr/", "http://example.com?/en/", "h://" + "a." * 2000 + "net/" + "d/" * 3000]
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    df = spark.createDataFrame(list(enumerate(urls)) + [(4, urls[4])], "page_id long, url string").withColumn("path", F.lit("own"))
    got = sorted((x.page_id, x.host, x._path, x.rule or "", x.verdict) for x in filter_urls(df, r).collect())
    want = []
    for i, u in [*enumerate(urls), (4, urls[4])]:
        host = path = ""
        if u and "://" in u:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host = lower(host)
        fits = [(len(h + p), v, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", ""))
        want.append((i, host, path, best[2], best[1]))
    assert got == sorted(want)
    assert filter_urls(df.limit(0), r).count() == 0


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    sp, codec, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), Codec.load(MODEL), random.Random(4)
    parts = ["a", "the", " ", "  ", "\t", "\n", "é", "日", "①", "in", "ing", "er", "\x00", "ﬁ", "!", "..", "7", "\U0001f600", "Hello", "tion"]
    texts = ["", " ", "   ", "x ", *("".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(2000)), "word" * 20_000]
    ids = codec.encode_batch(texts)
    assert ids == sp.encode(texts)
    assert [codec.decode(x) for x in ids] == texts
    df = docs(spark, corpus(1)).withColumn("decoded", F.lit("own"))
    rows = encode(df, MODEL).collect()
    assert len(rows) == len(corpus(1)) and all(x._decoded == (x.text or "") and x.token_ids == sp.encode(x.text or "") and x.decoded == "own" for x in rows)
    assert encode(docs(spark, []), MODEL).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_corpus(seed, n=90):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[r.choice(words) for _ in range(r.randint(3, 60))] for _ in range(6)]
    passage = [r.choice(words) for _ in range(20)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            w += passage
        if r.random() < 0.2:
            w = [r.choice(words) for _ in range(r.randint(1, 30))]
        rows.append((i, " ".join(w), None))
    return rows + [(200, None, ""), (201, "", ""), (202, "one two", ""), (203, "One  TWO", ""), (3, rows[3][1], ""), (204, "long word " * 30_000, ""), (205, "long word " * 29_000, "")]


@pytest.mark.parametrize("seed,hot", [(1, 24), (2, 2), (3, 1000)])
def test_ngram_join(spark, seed, hot):
    rows = near_corpus(seed)
    ids, sets = [i for i, _, _ in rows], [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i, x in enumerate(ids):
        least[root(i)] = min(least[root(i)], x)
    want = Counter((x, len(sets[i]), least[root(i)]) for i, x in enumerate(ids))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs(spark, rows).withColumn("set", F.lit(1)), hot=hot).collect())
    assert got == want


def test_ngram_join_of_nothing_and_null_ids(spark):
    assert ngram_join(docs(spark, [])).count() == 0
    got = ngram_join(docs(spark, [(None, "a b c d e f", ""), (7, "a b c d e f", ""), (None, "p q r s t u", "")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("7", "7"), ("None", "7"), ("None", "None")]


def test_null_and_repeated_ids_are_verified_and_one_row_stays(spark):
    """Texts of a null id link others; of each group one row stays, whatever its ids."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(words[:n]) for n in (32, 40, 50))  # 28, 36 and 46 shingles: a and c are near b only
    other, alone = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(1, a, "s"), (None, b, "s"), (2, c, "s"), (3, other, "s"), (3, other, "s"), (3, other + " x", "s"), (4, alone, "s"), (4, other + " z", "s"), (None, "p q r s t u", "s"), (None, "p q r s t u", "s"), (None, "", "s"), (None, "", "s")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs(spark, rows)).collect())
    assert got == Counter([(1, 28, 1), (None, 36, 1), (2, 46, 1), (3, 36, 3), (3, 36, 3), (3, 37, 3), (4, 36, 4), (4, 37, 3), (None, 2, None), (None, 2, None), (None, 0, None), (None, 0, None)])
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs(spark, rows), "").collect())
    assert left.pop((3, other), 0) + left.pop((3, other + " x"), 0) == 1
    assert left == Counter([(1, a), (4, alone), (None, "p q r s t u"), (None, ""), (None, "")])


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if x not in alone}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_pii_base(spark):
    r = random.Random(1)
    parts = [*"ab@.-+0123456789() _%\n", "1.2.3.4", "255", "256.", "4111 1111 1111 1111", "+49 (30) 1234", "é", "x@y.z", "日"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 60))), None) for i in range(1500)] + [(9000, None, ""), (9001, "", ""), (9002, "a." * 9000 + "x@" + "b." * 5000 + "c", ""), (9003, "1" * 30_000, ""), (9004, "1 " * 20_000, ""), (7, "x@y.z", "")]
    got = Counter((x.doc_id, tuple((s.kind, s.start, s.end) for s in x.base_spans)) for x in pii.find_pii(docs(spark, rows).withColumn("spans", F.lit(0))).collect())
    assert got == Counter((i, tuple(plain_spans(t))) for i, t, _ in rows)
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_pii_terms(spark):
    """A word that goes with an address alone gives it away; words that go elsewhere too don't."""
    rows = [(i, f"the zebra writes to ann@x.org ({i}) often", "") for i in range(5)] + [(10 + i, f"the horse writes often number {i}", "") for i in range(60)]
    out = {x.doc_id: x for x in pii.find_pii(docs(spark, rows)).withColumn("clean", pii.sanitise(F.col("text"), F.col("spans"))).collect()}
    assert [(s.kind, s.value) for s in out[0].spans] == [("term", "zebra"), ("term", "to"), ("email", "ann@x.org")]
    assert out[0].clean == "the  writes  [email] (0) often" and out[12].spans == [] and out[12].clean == rows[7][1]


def test_pii_terms_far_from_the_entity(spark):
    """A name at the top gives away an address at the bottom, and one behind 300 characters of an address; counts are of whole documents."""
    body = " ".join(["filler"] * 40)
    rows = [(i, f"Quagga {body} {i} ann@x.org", "") for i in range(4)] + [(10 + i, f"bob@x.org {'y' * 300} Okapi", "") for i in range(3)] + [(20 + i, f"filler {'y' * 300}", "") for i in range(60)] + [(90 + i, f"Tapir cy@x.org {i}", "") for i in range(2)]
    out = {x.doc_id: [(s.kind, s.value) for s in x.spans] for x in pii.find_pii(docs(spark, rows)).collect()}
    assert out[0] == [("term", "quagga"), ("email", "ann@x.org")] and out[10] == [("email", "bob@x.org"), ("term", "okapi")]
    assert out[20] == [] and out[90] == [("email", "cy@x.org")]


def test_pivot_keeps_words_and_whole_copies():
    r = random.Random(3)
    for _ in range(200):
        size = [r.randint(1, 50) for _ in range(r.randint(1, 20))]
        p = [r.choice([0.0, 0.25, 0.7]) for _ in size]
        done, rest = pivot(p, size, [r.random() for _ in size])
        assert done.count(-1) <= 1 and set(done) <= {-1, 0, 1}
        assert abs(sum(a * b for a, b in zip(p, size)) - sum(s * (rest if d == -1 else d) for d, s in zip(done, size))) < 1e-6


def test_mixing(spark):
    rows = corpus(3, 400)
    df = docs(spark, rows).withColumn("size", F.lit("own"))
    a, b = (mix(df.repartition(k)).collect() for k in (3, 5))
    key = lambda x: (str(x.doc_id), x.text or "", x.taken)
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, pool, free = {}, 1.5 * sum(totals.values()), set(order)
    while free:
        over = {s for s in free if pool * weight[s] / sum(weight[x] for x in free) > 2 * totals[s]}
        if not over:
            target |= {s: pool * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * totals[s] for s in over}
        pool -= sum(target[s] for s in over)
        free -= over
    taken = Counter()
    for x in a:
        assert x._size == size(x.text) and x.taken in (0, x._size, 2 * x._size) and x.source_size == totals[x.source] and abs(x.target - target[x.source]) < 1e-6 * max(1, x.target)
        taken[x.source] += x.taken
    most = max(size(t) for _, t, _ in rows)
    assert all(abs(taken[s] - target[s]) <= most for s in order)
    assert mix(docs(spark, [])).count() == 0 and mix(docs(spark, [(1, "", None), (2, None, "s")])).agg(F.sum("taken")).first()[0] == 0


def test_mixing_repeated_rows(spark):
    """Rows that repeat whole are dealt copies one by one, so a source of one text comes as near its target as others; reruns agree on how many of them get how many."""
    rows = [(1, "w " * 100, "a")] * 500 + [(1000 + i, "v " * (1 + i % 9), "b") for i in range(300)] + [(5000 + i % 7, "u " * 11, None) for i in range(90)]
    a, b = (mix(docs(spark, rows).repartition(k)) for k in (3, 7))
    told = lambda df: Counter((x.doc_id, x.source, x.taken) for x in df.collect())
    assert told(a) == told(b) and sum(told(a).values()) == len(rows)
    for x in a.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max(F.col("taken") / F.col("size")).alias("times")).collect():
        assert abs(x.taken - x.target) <= x.most and x.times <= 2


def test_mixing_tree(spark):
    """Many chunks: residuals meet in the tree and the sum still ends within a document of the target."""
    import palimpsest.llm.mixing as m

    chunk, fan = m.CHUNK, m.FAN
    m.CHUNK, m.FAN = 10, 3
    try:
        rows = [(i, "w " * (1 + i % 7), "s" if i % 3 else "t") for i in range(700)]
        out = mix(docs(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    finally:
        m.CHUNK, m.FAN = chunk, fan
    assert all(abs(x.taken - x.target) <= 7 for x in out)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5050, [float("inf")] + [1.0] * 15), (5100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 50 == 0, shard=900).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = x.astype(np.float64)
    n = np.sqrt((d * d).sum(1))
    hits = 0
    for q in range(0, 3000, 50):
        s = d @ d[q] / (n * n[q])
        s[q] = -9
        s = np.round(s, 12)
        want = np.lexsort((np.arange(3000), -s))[:5].tolist()
        hits += len(set(want) & {i for i, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(s[i] - v) < 1e-9 for i, v in got[q])
    assert set(got) == set(range(0, 3000, 50)) and hits >= 0.9 * 60 * 5
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = nearest(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_warc(spark, tmp_path):
    big = "é" * 60
    rows = [(3, "http://a/", big), (1, None, big), (2, "http://b/\r\nx", "small"), (4, "http://c/", "small"), (5, "u", None), (6, "u", "z" * 3_000_000), (7, "u", "z" * 3_000_000), (1, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1, r.payload) for r in round_trip(pages, f"file://{tmp_path}/a", payloads=True).collect())
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min(j for j, _, x in rows if x == h)
        revisit = len(raw) >= 100 and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else -1, None if revisit else raw))
    assert [(*g[:5], g[5] and bytes(g[5])) for g in got] == [(*w[:5], w[5] and w[5]) for w in sorted(want, key=lambda w: w[:5])]
    index = write_bundles(plan_records(pages), f"file://{tmp_path}/b").where("page_id = 2").first()
    fields, payload = fetch(index.bundle, index.frame, index.start, index.length)
    assert payload == b"small" and fields["WARC-Type"] == "response"
    assert round_trip(pages.limit(0), f"file://{tmp_path}/c").count() == 0


def test_warc_notices_a_spoilt_payload(spark, tmp_path):
    """Lengths and digests are those of what lies in the bundle, for revisits too; heads claim what was written."""
    import zstandard

    rows = [(i, "u", "same " * 40) for i in range(3)] + [(9, "u", "other")]
    index = write_bundles(plan_records(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), f"file://{tmp_path}/b")
    assert {r.payload_digest for r in read_bundles(index).where("record_type = 'response'").collect()} == {sha("same " * 40), sha("other")}
    for bundle in {r.bundle for r in index.collect()}:
        path = bundle.removeprefix("file://")
        with open(path, "rb") as f:
            raw = f.read()
        with open_bundle(bundle) as f:
            table = read_seek_table(f)
            plain = [read_frame(f, table, k).replace(b"same same", b"same-same") for k in range(len(table))]
        frames = [zstandard.ZstdCompressor(level=3).compress(x) for x in plain]
        with open(path, "wb") as f:
            f.write(b"".join(frames) + seek_table([(len(x), len(p)) for x, p in zip(frames, plain, strict=True)]))
        assert raw != open(path, "rb").read()
    got = {r.page_id: (r.claimed, r.payload_digest) for r in read_bundles(index).where("record_type = 'response'").collect()}
    assert got[9] == (sha("other"), sha("other")) and got[0][0] == sha("same " * 40) != got[0][1]


def test_warc_tasks_that_run_twice(spark, tmp_path):
    """The rows of a bundle in another order: another name, and both indexes read back right."""
    rows = [(i, "u", f"page {i} " * 30) for i in range(40)]
    records = plan_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    both = [write_bundles(records.orderBy(o).coalesce(1), f"file://{tmp_path}/b") for o in ("page_id", F.desc("page_id"))]
    assert not {r.bundle for r in both[0].collect()} & {r.bundle for r in both[1].collect()}
    for index in both:
        assert {r.page_id: bytes(r.payload).decode() for r in read_bundles(index).collect()} == {i: h for i, _, h in rows}


def test_quality_held_out(spark):
    from ..conftest import SF

    base = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = score_quality(d.withColumn("score", F.lit("own")), labels)
    assert {"score", "_score"} <= set(out.columns) and SF
    held = out.join(labels, "doc_id").where("held_out").select("quality", "predicted", "_score").toPandas()
    for q in (0, 1):
        assert (held[held.quality == q].predicted == q).mean() >= 0.95
    assert held._score.between(0, 1).all()
    edge = score_quality(docs(spark, corpus(1)), labels).collect()
    assert len(edge) == len(corpus(1)) and all(0 <= x.score <= 1 for x in edge)
    assert {x.predicted for x in score_quality(docs(spark, corpus(1)), labels.limit(0)).collect()} == {1}
    assert score_quality(docs(spark, []), labels).count() == 0
