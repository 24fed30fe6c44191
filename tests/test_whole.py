"""Queries that must see whole texts and all rows, on small made-up tables."""

import random

import pytest

from palimpsest.operators import similarity
from palimpsest.plans.bind import HEADS, TAILS
from palimpsest.plans.catalog import QUERIES

WORDS = [a + b for a in ("bra", "cle", "dro", "fli", "gru", "pla", "sti", "tro") for b in ("mble", "nder", "ckle", "ster", "ving", "lmed", "rtho", "bbin")]


def prose(seed, n=200):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(n))


def put(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def long_documents(spark, tmp_path_factory):
    docs = [(i, prose(i)) for i in range(40)] + [(64, prose(0)), (80, "short")]
    return dict(docs), put(spark, tmp_path_factory.mktemp("long"), documents=(docs, "doc_id long, text string"), benchmark=([(i, prose(i)) for i in range(10)], "item_id long, text string"))


def test_projection_weighs_whole_entries(spark, long_documents):
    docs, d = long_documents
    want = {i: (len(HEADS.get(i % 16, "") + t + TAILS[i % 16]) + 3) // 4 + 1 for i, t in docs.items()}
    assert {r.ref: r.tokens for r in QUERIES["projection_scores"](spark, d).collect()} == want


def test_long_copies_are_merged(spark, long_documents):
    """Documents 0 and 64 are copies; their cuts were 40 and 720 characters long."""
    docs, d = long_documents
    got = {r.ref: r for r in QUERIES["rewrite_decisions"](spark, d).collect()}
    assert (got[0].action, got[0].rewrite, got[0].char_delta) == ("merge", "merge_absorb", -len(docs[0])) and got[64].action != "merge"


def test_facts_that_repeat_any_entry_are_duplicates(spark, tmp_path):
    """Entry 64 is the only one that the fact of conversation 3, turn 5 repeats."""
    said = prose(7, 12)
    d = put(spark, tmp_path, documents=([(1, prose(1)), (64, said)], "doc_id long, text string"), conversations=([(3, 5, "user", said), (11, 5, "user", prose(9, 12))], "conv_id long, turn long, role string, text string"))
    assert {r.id: r.category == "near_duplicate" for r in QUERIES["adjudication"](spark, d).collect()} == {3005: True, 11005: False}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, seed):
    r = random.Random(seed)
    sets = lambda n, most: [(i, r.sample("abcdefghijklmno", r.randint(0, most))) for i in range(n)]
    left, right = sets(60, 9), sets(25, 12)
    near = lambda x, y: len(x & y) >= 0.6 * len(x | y) or len(x & y) >= 0.7 * len(x)
    want = {i for i, x in left if x and any(near(set(x), set(y)) for _, y in right if y)}
    schema = "id long, tokens array<string>"
    assert {x.id for x in similarity.repeats(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.6, 0.7).collect()} == want


def test_facts_see_whole_turns(spark, tmp_path):
    """What makes the turn a passing one stands after its 200th character."""
    said = prose(8, 40)
    assert len(said) > 200
    d = put(spark, tmp_path, documents=([(1, prose(1))], "doc_id long, text string"), conversations=([(3, 5, "user", said + " for now"), (11, 5, "user", said)], "conv_id long, turn long, role string, text string"))
    assert {r.id: r.category == "scoped_or_temporary" for r in QUERIES["adjudication"](spark, d).collect()} == {3005: True, 11005: False}
