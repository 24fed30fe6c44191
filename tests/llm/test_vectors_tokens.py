"""Token files, vector codes and hard negatives against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.hard_negatives import bounds, mined
from palimpsest.llm.queries import QUERIES, WORDS
from palimpsest.llm.token_files import Encoder, TokenFile, read_tokens, write_tokens
from palimpsest.llm.vector_codes import compressed

from ..conftest import SF
from .test_edges import NAMES, SCHEMA
from .test_edges import rows_of as crowded_rows


def crowded(df):
    return df.select("*", *[F.lit("own").alias(n) for n in [*NAMES, "part", "place", "h", "label_", "code", "error", "strip", "path", "asked", "n_docs"] if n not in df.columns and n not in ("path",)], F.create_map(F.lit("a"), F.lit(1)).alias("tags"))


# token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_words_encode_as_texts_do(library):
    encoder, r = Encoder(open(WORDS, encoding="utf-8").read()), random.Random(3)
    assert encoder.by_piece
    alphabet = "aAbB,.;:)(\"&*-_@#[]{}~` \t\n\x0b\x0c\r\x1c\x1d\x85\xa0 　​'sTreLL1!?́̈İΣσÅ각가️\U0001f600<|>ßﬁक़\xad\x00"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["a<|endoftext|>b <|startoftext|>", "x" * 5000, "it's we'll O'Clock", "don.'t a,'s b.'S", "ñ, ñ, 1,2", "\x00 a\x00b", ""]
    ids, sizes = encoder.encode(pa.array(texts, pa.large_string()))
    at = 0
    for t, n in zip(texts, sizes, strict=True):
        assert list(ids[at : at + n]) == library.encode(t, add_special_tokens=False).ids, t
        at += n


def test_token_files_round_trip(spark, library, tmp_path):
    """Ids, starts and order; nulls, repeats and long texts; what stands in the files is what is read."""
    rows = crowded_rows()
    manifest = write_tokens(crowded(spark.createDataFrame(rows, SCHEMA)), WORDS, f"file://{tmp_path}/t")
    got = read_tokens(manifest, ids=True).orderBy("start").collect()
    want = Counter((r[0], tuple(ids_of(library, r[1]))) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    order = [r.doc_id for r in got]
    assert [x for x in order if x is not None] == sorted(x for x in order if x is not None) and order[-order.count(None) :] == [None] * order.count(None)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += len(r.ids)
    files = manifest.orderBy("part").collect()
    flat = np.concatenate([np.fromfile(f.ids_path[7:], dtype="<u2") for f in files])
    assert flat.tolist() == [i for r in got for i in r.ids]
    bases = np.cumsum([0, *[os.path.getsize(f.ids_path[7:]) // 2 for f in files]])
    assert [f.base_ids for f in files] == bases[:-1].tolist()
    one = TokenFile(files[0].ids_path, files[0].idx_path)
    assert one.tokens(1).tolist() == got[1].ids
    empty = write_tokens(spark.createDataFrame([], SCHEMA), WORDS, f"file://{tmp_path}/e")
    assert empty.count() == 0 and read_tokens(empty).count() == 0


def test_repeats_are_dealt_over_files(spark, library, tmp_path):
    rows = [(7, "the same words", "en", "s", 1)] * 3000 + [(i, f"text {i}", "en", "s", 1) for i in range(6)]
    manifest = write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(8), WORDS, f"file://{tmp_path}/t")
    assert [r.doc_id for r in read_tokens(manifest).orderBy("start").collect()] == sorted(r[0] for r in rows)


def test_token_files_query(spark, library):
    import pyarrow.parquet as pq

    at = 0
    got = {r.doc_id: r for r in QUERIES["op11_token_files"](spark, SF).collect()}
    for r in sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"]):
        ids = ids_of(library, r["text"])
        assert tuple(got.pop(r["doc_id"])) == (r["doc_id"], at, len(ids), crc(ids))
        at += len(ids)
    assert not got


# vector codes

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts, entries, rounds, scale):
    """(code, error) by row, and the codebooks, in Python integers."""
    kept = sorted(([(r[0] is None, r[0] or 0), [int(np.floor(scale * float(np.float32(x)))) for x in r[1]], r[2]] for r in rows), key=lambda r: (r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda r, p: min(range(len(books[p])), key=lambda e: (far(cut(r[1], p), books[p][e]), e))
    for _ in range(rounds):
        codes = [[nearest(r, p) for r in kept] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(r[1], p) for r, c in zip(kept, codes[p], strict=True) if c == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, label_error = [], Counter()
    for r in kept:
        code = [nearest(r, p) for p in range(parts)]
        error = sum(far(cut(r[1], p), books[p][c]) for p, c in enumerate(code))
        out.append((r[0][1] if not r[0][0] else None, "".join(f"{c:02x}" for c in code), error, r[2]))
        label_error[r[2]] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, label_error[label], sha) for i, code, error, label in out)


def told_codes(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("grid", [None, 2, 1])
def test_codes_equal_brute_force(spark, grid):
    """A coarse grid makes ties and equal entries common; huge components are exact too."""
    r = random.Random(grid or 9)
    draw = (lambda: r.gauss(0, 0.3)) if grid is None else (lambda: r.randrange(-grid, grid + 1) / 8)
    rows = [(i, [draw() for _ in range(8)], r.choice([0, 1, None])) for i in range(400)]
    rows += [rows[5], rows[5], (None, [draw() for _ in range(8)], 1), (7, [draw() for _ in range(8)], 2)]
    if grid is None:
        rows += [(900 + i, [r.choice([-1, 1]) * r.uniform(1e3, 1e5) for _ in range(8)], 3) for i in range(5)]
    out = [(800, None, 1), (801, [1.0] * 7 + [None], 1), (802, [1.0] * 7 + [float("nan")], 1), (803, [float("inf")] * 8, 1), (804, [1.0] * 5, 1), (805, [], 1)]
    df = spark.createDataFrame(rows + out, VECTORS)
    got, books, scans = compressed(crowded(df), entries=32)
    assert told_codes(got) == plain_codes(rows, 4, 32, 4, 1024)
    # the first assignment scans all parts in full, later ones fewer
    assert scans[0] == 4 * len(rows) and all(s < scans[0] for s in scans[1:])


def test_codes_of_few_rows_and_none(spark):
    rows = [(3, [0.1, 0.2, 0.3, 0.4], 1), (1, [0.1, 0.2, 0.3, 0.4], 1), (2, [-0.5, 0.0, 0.5, 1.0], None)]
    df = spark.createDataFrame(rows, VECTORS)
    assert told_codes(compressed(df)[0]) == plain_codes(rows, 4, 256, 4, 1024)
    assert compressed(df.limit(0))[0].count() == 0 and compressed(df.where("vec_id = 2"))[0].first().error == 0


# hard negatives


def plain_negatives(rows, asked, positives, negatives, low, high, scale):
    ints = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label) for i, v, label in rows]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, v, label in dict.fromkeys((i, tuple(v), label) for i, v, label in ints if asked(i)):
        every = sorted(((-score(v, w), i, m == label) for i, w, m in ints))
        for p, pid, _ in [x for x in every if x[2] and x[1] != a][:positives]:
            near = [x for x in every if not x[2] and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(a, pid, k, i, -p, -s) for k, (s, i, _) in enumerate(near, 1)]
    return Counter(out)


@pytest.mark.parametrize("grid,block", [(None, 1024), (2, 3), (1, 5)])
def test_negatives_equal_brute_force(spark, grid, block):
    r = random.Random(grid or 4)
    draw = (lambda: r.gauss(0.1, 0.4)) if grid is None else (lambda: r.randrange(-grid, grid + 1) / 4)
    rows = [(i, [draw() for _ in range(6)], r.randrange(4)) for i in range(300)]
    rows += [rows[10], rows[10], (20, [draw() for _ in range(6)], 1), (20, [0.5] * 6, 3)] + [(1000 + i, [0.5] * 6, 2) for i in range(60)]
    if grid is None:
        rows += [(2000 + i, [r.choice([-1, 1]) * r.uniform(1e3, 1e5) for _ in range(6)], 1) for i in range(4)]
    rows.append((5000, [0.3] * 6, 77))  # alone in its label
    out = [(800, None, 1), (810, [1.0] * 6, None), (820, [1.0] * 5 + [None], 1), (830, [float("nan")] * 6, 1), (840, [1.0] * 3, 1), (None, [1.0] * 6, 1)]
    got, told = mined(crowded(spark.createDataFrame(rows + out, VECTORS)), F.col("vec_id") % 10 == 0, block=block)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0, 5, 10, 30, 90, 256)
    pairs, verified = told.agg(F.sum("pairs"), F.sum("verified")).first()
    assert verified < pairs


def test_bounds_and_empty(spark):
    for p in [*range(-300, 301), 2**58 - 1, -(2**58) + 7]:
        low, high = bounds(np.array([p]), 30, 90)
        assert (int(low[0]), int(high[0])) == (-(-30 * p // 100), 90 * p // 100)
    df = spark.createDataFrame([(1, [1.0, 2.0], 1)], VECTORS)
    for d in (df.limit(0), df):
        assert mined(d, F.col("vec_id") % 10 == 0)[0].count() == 0
