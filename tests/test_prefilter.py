"""Patterns with their prefilter and linear forms against the patterns themselves, on random texts of the patterns' own phrases."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import patterns as P
from palimpsest.functions.prefilter import can_occur, linear, phrases, required, seen
from palimpsest.functions.text import says

NAMES = [k for k, v in vars(P).items() if isinstance(v, str) and k.isupper() and k not in ("ODD", "PLAIN", "PATH", "TOPIC", "FACT_DATE", "TEXT_DATE", "RELATIONS", "IDENTIFIER")]


def texts(seed):
    r = random.Random(seed)
    bits = sorted({w for k in NAMES for w in re.findall(r"[A-Za-z'/_~.]+", getattr(P, k))}) + ["the", "broke", "12", "3/4", "2024-05-06", "55 %", "9 ms", "v1.2.3", "ſet", "Kubernetes", "é", "noẃ", "ıs", "\n", " ", "→", "✅", "default", "password"]
    out = ["", "the log broke", "the x\nbroke", "the x \nthe y broke", "approval before x\n trade", "APPROVAL BEFORE LIVE TRADE", "do not click a\nPayment UI", "never log my api key", "ſet to", "never log it to kens", "x_now", "now_x", "so far", "skill:x", "myskill", "Kill", "tasK is paused", "ısolated is actıve", "١٢ / ٣"]
    for _ in range(600):
        out.append(r.choice([" ", " ", "", "\n", "-", ", "]).join(r.choice(bits) if r.random() < 0.8 else r.choice(bits).upper() for _ in range(r.randint(1, 9))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nothing_is_missed(spark, seed):
    df = spark.createDataFrame([(t,) for t in texts(seed)], "t string").withColumn("s", seen(F.col("t")))
    plain = lambda p: F.when(F.octet_length("t") == F.length("t"), F.col("t").rlike("(?i)" + p)).otherwise(F.col("t").rlike("(?iuU)" + p))
    out = df.select("t", *[F.struct(plain(getattr(P, k)).alias("a"), says(F.col("t"), getattr(P, k)).alias("b"), says(F.col("t"), getattr(P, k), F.col("s")).alias("c")).alias(k) for k in NAMES]).collect()
    hits = 0
    for r in out:
        for k in NAMES:
            assert r[k].a == r[k].b == r[k].c, (k, r.t, r[k])
            hits += r[k].a
    assert hits > len(out)


def test_what_is_required():
    assert required(P.DURABLE_VERB)[0] == ("confirmed", "verified")
    assert set(required(r"\b(at the moment|prefers?|a[bc]d)\b")[0]) == {"moment", "prefer", "prefers", "abd", "acd"}
    assert required(r"(~/|\bread \b|x)")[1] is None and required(r"(~/|\bread \b|\.md\b)")[1] == (".md", "read ", "~/")
    assert required(r"\b\w+ly\b") == (None, ("ly",))
    assert [p for p, _ in linear(P.TEMPORAL)] == [P.TEMPORAL] and len(linear(P.SAFETY_PIN)) == 4


def test_long_texts_take_linear_time(spark):
    text = F.concat(F.repeat(F.lit("the approval before do not click never log "), 3000), F.repeat(F.lit("x"), 2000))
    df = spark.range(1).select(text.alias("t")).cache()
    df.count()
    began = time.time()
    row = df.select(*[says(F.col("t"), p).alias(k) for k, p in (("d", P.DEBUG), ("s", P.SAFETY_PIN))]).first()
    assert (row.d, row.s) == (False, False) and time.time() - began < 5


def test_a_phrase_is_asked_for_whole():
    assert phrases(P.TODO)[1] == ("follow up", "follow-up", "next step", "to do") and "to" not in phrases(P.TODO)[0]
    assert phrases(P.DURABLE_VERB) is None and phrases(P.METRIC) is None


def test_fixed_digits_need_no_search_for_digits(spark):
    plan = lambda p: str(can_occur(F.struct(F.col("t").alias("low"), F.array("t").alias("words")), p))
    assert "rlike" not in plan(P.INLINE_DATE).lower() and "rlike" in plan(P.METRIC).lower()
