"""Keys of a pass over the files and of rewrites, against the loops that define them."""

import random

import pytest

from palimpsest.functions.text import content_hash
from palimpsest.operators import rewrite, temporal
from pyspark.sql import functions as F


def pass_over(rows):
    """(store, ref, key, hash) in order of ref, one by one; what was placed is shared by equal contents under their key."""
    placed, names, out = {}, {}, []
    for store, ref, key, h in sorted(rows, key=lambda r: r[1]):
        own = names.setdefault(store, set())
        if (store, key, h) not in placed:
            name, n = key, 1
            while name in own:
                n += 1
                name = f"{key}-{n}"
            placed[store, key, h] = name
            own.add(name)
        out.append((store, ref, placed[store, key, h]))
    return sorted(out)


def numbered(spark, rows):
    m = spark.createDataFrame([(*r, "UPDATE") for r in rows], "store string, ref long, fact_key string, hash string, decision string")
    return sorted((r.store, r.ref, r.fact_key) for r in temporal.number_collisions(m).collect())


@pytest.mark.parametrize("order", [["x", "x", "x-2"], ["x-2", "x", "x"], ["x", "x-2", "x", "x", "x-2"], ["x-2-2", "x-2", "x", "x", "x"], ["x", "x", "x", "x-3", "x", "x-02", "x-1", "x--2"]])
def test_numbers_never_meet(spark, order):
    rows = [("m", i, k, f"h{i}") for i, k in enumerate(order)]
    got = numbered(spark, rows)
    assert got == pass_over(rows) and len({k for _, _, k in got}) == len(order)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passes(spark, seed):
    r = random.Random(seed)
    keys = ["x", "x-2", "x-3", "x-4", "x-2-2", "x-2-3", "x-5", "y", "y-2"]
    rows = [(r.choice("mu"), i, r.choice(keys if seed == 1 else keys[:4]), f"h{r.randrange(40)}") for i in range(120)]
    assert numbered(spark, rows) == pass_over(rows)


def test_rewrites_find_their_facts(spark):
    """By current hash, by any version's hash, by the derived key with a number; a fact is taken once; what is recorded already gives nothing."""
    h = lambda t: spark.range(1).select(content_hash(F.lit(t))).first()[0]
    texts = {1: "Alpha: one", 2: "Beta: two", 3: "Gamma: three", 4: "Gamma: four", 5: "Alpha: one", 6: "Delta: five", 7: "Epsilon: six"}
    new = {1: "p1", 2: None, 3: "p3", 4: "p4", 5: "p5", 6: "Delta: five", 7: "p7"}
    d = spark.createDataFrame([(i, "m", t, new[i]) for i, t in texts.items()], "ref long, store string, text string, new_text string")
    facts = [("fact-a", h(texts[1]), 2, 1, "update"), ("fact-b", h(texts[2]), 1, 0, "create"), ("fact-b", h("now"), 2, 1, "update"), ("fact-e", h(texts[7]), 1, 0, "create"), ("fact-e", h("p7"), 2, 1, "update")]
    known = spark.createDataFrame([("m", *f) for f in facts], "store string, fact_key string, hash string, version int, is_current int, op string")
    resolved = rewrite.resolve_facts(d, known)
    got = {r.ref: (r.fact_key, r.how, r.op) for r in resolved.collect()}
    assert got == {1: ("fact-a", "current", "update"), 2: ("fact-b", "past", "archive"), 3: ("gamma", "derived", "update"), 4: ("gamma-2", "derived", "update"), 5: ("alpha", "derived", "update"), 7: ("fact-e", "past", "update")}
    events = {(r.ref, r.step): (r.fact_key, r.op, r.content, r.source) for r in rewrite.record_rewrite(resolved, known, d).collect()}
    assert events[1, 0] == ("fact-a", "update", "p1", "rewrite") and (1, 1) not in events and events[2, 0] == ("fact-b", "delete", texts[2], "rewrite")
    assert events[3, 0] == ("gamma", "create", texts[3], "pre-rewrite-baseline") and events[3, 1] == ("gamma", "update", "p3", "rewrite") and not {k for k in events if k[0] == 7}
