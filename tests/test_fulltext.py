"""The stored index against searches of the texts themselves, through appends, replacements, removals, merges and the loss of a kind."""

import math
import random
import re

import pytest

from palimpsest.operators import fulltext
from palimpsest.operators.fulltext import Index


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def corpus(r, ids):
    vocabulary = [f"w{i}" for i in range(30)] + ["common"] * 20 + ["Ünder", "don't", "x-ray"]
    return {i: " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25))) for i in ids}


def words(t):
    return re.findall(r"[a-z0-9]+", t.lower())


def phrases(texts, asked):
    out = set()
    for q, p in asked.items():
        p = words(p)
        for i, t in texts.items():
            w = words(t)
            hits = sum(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1)) if p else 0
            if hits:
                out.add((q, i, hits))
    return out


def holding(texts, asked):
    return {(q, i) for q, p in asked.items() for i, t in texts.items() if p and p.lower() in t.lower()}


def found(index, spark, texts, asked):
    q = spark.createDataFrame([*asked.items(), (99, None), (98, "")], "query_id long, text string")
    assert {tuple(x) for x in index.phrases(q).collect()} == phrases(texts, asked)
    if "gram" in index.kinds:
        assert {tuple(x) for x in index.substrings(q, frame(spark, list(texts.items()))).collect()} == holding(texts, asked)


def test_index_through_its_life(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    r = random.Random(7)
    texts, index = corpus(r, range(-20, 60)), Index(spark, f"{tmp_path}/i")
    asked = {1: "common w1", 2: "common common", 3: "ünder", 4: "w2", 5: "don't", 6: "ommon w", 7: "on", 8: "w1 w1 w1", 9: "nowhere to be found", 10: "x-ray common"}
    index.append(frame(spark, [*list(texts.items())[:50], (None, "common w1")]))
    index.append(frame(spark, list(texts.items())[50:]))
    found(index, spark, texts, asked)
    again = corpus(r, range(0, 10)) | {3: None, 200: "common common w1 W1"}
    index.append(frame(spark, list(again.items())))
    texts |= {i: t or "" for i, t in again.items()}
    index.remove(frame(spark, [(5, ""), (-3, "")]))
    texts = {i: t for i, t in texts.items() if i not in (5, -3)}
    found(index, spark, texts, asked)
    with pytest.raises(ValueError):
        index.best(spark.createDataFrame([(1, ["common"])], "query_id long, tokens array<string>"), 3)
    index.merge()
    found(index, spark, texts, asked)
    assert index.table("word").select("segment").distinct().count() == 1
    index.drop("gram")
    found(index, spark, texts, asked)
    assert index.table("gram").count() == 0


def test_appends_that_break_off_are_not_found(spark, tmp_path, monkeypatch):
    index = Index(spark, f"{tmp_path}/i", ("word",))
    index.append(frame(spark, [(1, "old words")]))
    monkeypatch.setattr(index, "_tell", lambda rows, mode="append": (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.append(frame(spark, [(1, "new words"), (2, "new words")]))
    monkeypatch.undo()
    q = spark.createDataFrame([(1, "new words"), (2, "old words")], "query_id long, text string")
    assert [tuple(x) for x in index.phrases(q).collect()] == [(2, 1, 1)]


@pytest.mark.parametrize("k", [1, 5])
def test_best_equals_all_scores(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(fulltext, "BLOCK", 32)
    monkeypatch.setattr(fulltext, "FIRST", 2)
    r = random.Random(k)
    texts = {i: " ".join([*(f"w{int(r.paretovariate(0.4)) % 300}" for _ in range(30)), *(["the"] if r.random() < 0.9 else []), *(["of"] if r.random() < 0.7 else [])]) for i in range(600)}
    index = Index(spark, f"{tmp_path}/i", ("word",))
    index.append(frame(spark, list(texts.items())))
    asked = {q: sorted({"the", "of", *(f"w{r.randrange(1, 300)}" for _ in range(5)), "missing"}) for q in range(6)} | {50: ["nowhere"], 51: ["the"], 52: []}
    got, counts = index.best(spark.createDataFrame(list(asked.items()), "query_id long, tokens array<string>"), k)
    mine = {}
    for x in got.collect():
        mine.setdefault(x.query_id, {})[x.id] = round(x.score, 9)
    bags = {i: set(words(t)) for i, t in texts.items()}
    for q, tokens in asked.items():
        w = {t: math.log1p(len(texts) / d) if (d := sum(t in b for b in bags.values())) else math.log1p(len(texts)) for t in tokens}
        scores = {i: round(sum(w[t] for t in tokens if t in b) / sum(w.values()), 9) for i, b in bags.items() if any(t in b for t in tokens)} if tokens else {}
        edge = sorted(scores.values(), reverse=True)[:k][-1:] or [2]
        assert mine.get(q, {}) == pytest.approx({i: s for i, s in scores.items() if s >= edge[0]}), q
    for c in counts.where("query_id < 6").collect():
        assert c.kept <= c.opened < c.postings / 2


def test_lists_of_a_term_are_shuffled_and_written_once(spark, tmp_path, monkeypatch):
    """A merge writes an index's data once, and its commit that leaves the old segments behind names files that are there."""
    import os

    index = Index(spark, f"{tmp_path}/i", ("word",))
    texts = corpus(random.Random(3), range(40))
    index.append(frame(spark, list(texts.items())))
    index.append(frame(spark, list(texts.items())[:9]))
    before = set(os.listdir(f"{tmp_path}/i/word/data"))
    seen = []
    monkeypatch.setattr(fulltext, "write_table", lambda df, path, mode="append", real=fulltext.write_table: (seen.append((os.path.basename(path), mode)), real(df, path, mode)))
    index.merge()
    assert seen == [("word", "append"), ("docs", "overwrite")]
    held = {os.path.basename(f) for f in index.table("word").inputFiles()}
    assert held and held == set(os.listdir(f"{tmp_path}/i/word/data")) - before
    found(index, spark, texts, {1: "common w1", 2: "common common"})


def test_pieces_that_interleave_and_are_cut(spark, monkeypatch):
    """Texts in no order, a few characters at a time and rows a batch, give the same sorted lists; ranges of negative ids too."""
    monkeypatch.setattr(fulltext, "BLOCK", 8)
    texts = corpus(random.Random(5), range(-11, 30)) | {40: "ſharp 😀😀😀x common"}
    rows = list(texts.items())
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = fulltext.word_blocks(frame(spark, rows), "s").collect()
        grams = fulltext.gram_blocks(frame(spark, rows), "s").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, pieces = {}, {}
    for i in sorted(texts):
        low = texts[i].lower()
        for at, w in enumerate(words(low)):
            want.setdefault((w, i // 8), {}).setdefault(i, []).append(at)
        for g in {low[k : k + 3] for k in range(len(low) - 2)}:
            pieces.setdefault((g, i // 8), []).append(i)
    assert len(got) == len(want) and {(r.term, r.block): dict(zip(r.ids, r.positions)) for r in got} == want and all(list(r.ids) == sorted(r.ids) and r.n == len(r.ids) for r in got)
    assert len(grams) == len(pieces) and {(r.term, r.block): list(r.ids) for r in grams} == pieces
