"""Quality scores by Bradley-Terry ranking.

Of each pair of a labelled good and a labelled bad document the good one wins with probability
sigma(w . (x_good - x_bad)); w minimises the logistic loss of those feature differences, with a quadratic penalty.
A document's worth is w . x. Of the labelled rows a part (CALIBRATE) is kept out of the pairs: the cut is the quantile of its worths at its share of bad labels, and
score = sigma(worth - cut + logit(0.7)), so 0.7 is where the cut lies. Features come from the
text alone: the frequencies of its hashed words, pairs of words and runs of three bytes (HASHED places for words and pairs, as many for runs; each part as square roots of shares), and a
few shares of signs and repeats. Words are split at ASCII white space, A-Z lower-cased. A null or empty text has features 0 and is scored as such.
A text is read whole; one of over STEP bytes in runs that are cut at white space, where the pair or run of bytes across the cut isn't counted.

Only the fit is bounded: at most SAMPLE labelled rows, those with the least hash, and PAIRS pairs. Scoring covers every row.
Labels of null quality are left out. Without a good and a bad label nothing can be learnt and every
score is 0.7. Rows that repeat, and texts that are equal, score the same each. Extra columns pass through, also those named like columns used here. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, text_of
from .shingles import mix, release, text_buffers, word_hashes

SAMPLE, PAIRS, KEEP_AT, CALIBRATE = 8000, 60_000, 0.7, 0.3
LOGIT = float(np.log(KEEP_AT / (1 - KEEP_AT)))
#: Places for hashed features of a kind, bytes of text and texts looked at at once, weight of the penalty.
HASHED, STEP, TEXTS, PENALTY = 1024, 1 << 20, 256, 0.001
#: Deviation that hashed features are scaled to, the shares having 1: there are 300 times as many, and the penalty holds them back until there are pairs that the shares can't tell apart.
FAINT = 0.02
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def shares(c: Column) -> list[Column]:
    """log(1 + 100 * share): marks, bangs, bars, capitals, digits; words equal to the one before; lines equal to the one before; other signs."""
    n = F.greatest(F.length(c), F.lit(1))
    share = lambda part: F.log1p(100.0 * part / n)
    count = lambda chars: F.length(c) - F.length(F.translate(c, chars, ""))
    words, lines = F.split(c, r"[\x20\x09-\x0D]+"), F.split(c, "\n")
    again = lambda a: F.log1p(100.0 * F.size(F.filter(F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: x == y), lambda x: x)) / F.size(a))
    return [
        share(F.regexp_count(c, F.lit(r"[#$%&*@^~_=\\<>]"))),
        share(F.regexp_count(c, F.lit("[!?]"))),
        share(F.regexp_count(c, F.lit(r"\|"))),
        share(F.regexp_count(c, F.lit(r"\p{Lu}"))),
        share(F.regexp_count(c, F.lit(r"[0-9]"))),
        again(words),
        again(lines),
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, text after the last, byte offsets) of runs of texts, or of parts of one long text."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = min(at + TEXTS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, side="right")) - 1))
        lo, hi = int(offsets[at]), int(offsets[end])
        if end > at + 1 or hi - lo <= STEP:
            yield at, end, offsets[at : end + 1]
        else:
            while lo < hi:
                cut = min(lo + STEP, hi)
                if cut < hi:
                    space = np.flatnonzero(data[lo:cut] <= 32)
                    cut = lo + int(space[-1]) + 1 if len(space) else cut
                yield at, end, np.array([lo, cut])
                lo = cut
        at = end


def hashed(column) -> np.ndarray:
    """Frequencies of hashed words and pairs, and of runs of three bytes, as square roots of shares: a row a text, 2 * HASHED wide."""
    data, offsets = text_buffers(column)
    shift = np.uint64(64 - (HASHED - 1).bit_length())
    out = np.zeros((len(offsets) - 1, 2 * HASHED), dtype=np.float32)
    for first, last, cut in _runs(data, offsets):
        words, count = word_hashes(data, cut)
        text = np.repeat(np.arange(last - first), count)
        pair = np.flatnonzero(text[1:] == text[:-1])
        place = np.concatenate([mix(words) >> shift, mix(words[pair] * _A + words[pair + 1] * _B) >> shift]).astype(np.int64)
        size = (last - first) * HASHED
        out[first:last, :HASHED] += np.bincount(np.concatenate([text, text[pair]]) * HASHED + place, minlength=size).reshape(-1, HASHED)
        raw, of = data[cut[0] : cut[-1]].astype(np.uint64), np.repeat(np.arange(last - first), np.diff(cut))
        if len(raw) > 2:
            inside = np.flatnonzero(of[2:] == of[:-2])
            gram = mix((raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16))[inside] * _A) >> shift
            out[first:last, HASHED:] += np.bincount(of[inside] * HASHED + gram.astype(np.int64), minlength=size).reshape(-1, HASHED)
    for half in (out[:, :HASHED], out[:, HASHED:]):
        half /= np.maximum(half.sum(axis=1, keepdims=True), 1)
    return np.sqrt(out)


@dataclass
class Ranking:
    """Weights of the hashed features and of the shares, and the worth at which 0.7 lies."""

    weights: np.ndarray
    cut: float

    def scores(self, text, some: list) -> np.ndarray:
        worth = hashed(text) @ self.weights[: 2 * HASHED]
        for w, x in zip(self.weights[2 * HASHED :], some, strict=True):
            worth = worth + w * x.to_numpy(zero_copy_only=False)
        return 1 / (1 + np.exp(-np.clip(worth - self.cut + LOGIT, -700, 700)))


def minimise(f, w: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps on f, which gives a value and a gradient, halved until the value falls."""
    value, slope = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, held = slope.copy(), []
        for ds, dg in reversed(past):
            held.append((ds @ q) / (ds @ dg))
            q -= held[-1] * dg
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (ds, dg), a in zip(past, reversed(held), strict=True):
            q += (a - (dg @ q) / (ds @ dg)) * ds
        size = 1.0
        while True:
            at = w - size * q
            new, new_slope = f(at)
            if new <= value - 1e-4 * size * (slope @ q) or size < 1e-6:
                break
            size /= 2
        if size < 1e-6 or value - new < 1e-7 * abs(value):
            return w if size < 1e-6 else at
        if (at - w) @ (new_slope - slope) > 1e-12:
            past = [*past[1 - memory :], (at - w, new_slope - slope)]
        w, value, slope = at, new, new_slope
    return w


def bradley_terry(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, penalty: float = PENALTY, seed: int = 1) -> np.ndarray:
    """Weights that minimise the mean logistic loss of random (good, bad) pairs of rows of x, features scaled by their deviations."""
    rng = np.random.default_rng(seed)
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    a, b = yes[rng.integers(len(yes), size=pairs)], no[rng.integers(len(no), size=pairs)]
    # the weights are scaled and not the features, and deviations are taken by few columns at once: neither makes a copy of x
    scale = np.concatenate([x[:, k : k + 64].std(axis=0, dtype=np.float64) for k in range(0, x.shape[1], 64)]).astype(np.float32) + np.float32(1e-3)
    scale[: 2 * HASHED] /= FAINT

    def loss(w):
        worth = x @ (w / scale).astype(np.float32)
        d = (worth[a] - worth[b]).astype(np.float64)
        p = -1 / (1 + np.exp(np.clip(d, -60, 60))) / pairs
        pull = np.bincount(a, p, len(x)) - np.bincount(b, p, len(x))
        return np.logaddexp(0, -d).mean() + penalty / 2 * (w @ w), (pull.astype(np.float32) @ x).astype(np.float64) / scale + penalty * w

    return minimise(loss, np.zeros(x.shape[1])) / scale


def fit(x: np.ndarray, good: np.ndarray, seed: int = 2) -> Ranking | None:
    """The ranking of labelled rows; None where a label is missing."""
    if good.all() or not good.any():
        return None
    apart = np.random.default_rng(seed).random(len(x)) < CALIBRATE
    if min(good[apart].sum(), (~good[apart]).sum(), good[~apart].sum(), (~good[~apart]).sum()) == 0:
        apart = np.zeros(len(x), bool)
    w = bradley_terry(x[~apart], good[~apart])
    held = apart if apart.any() else ~apart
    worth = np.sort(np.concatenate([x[i : i + 512].astype(np.float64) @ w for i in range(0, len(x), 512)])[held])
    k = min(max(1, int((~good[held]).sum())), len(worth) - 1)
    return Ranking(w, float((worth[k - 1] + worth[k]) / 2))


def _labelled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `sample` rows, which bounds what is broadcast and collected."""
    import pyarrow as pa

    vector = F.arrow_udf(lambda t: pa.array([x.tobytes() for x in hashed(t)], pa.binary()), "binary")
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    few = F.broadcast(some)
    names = [f"f{i}" for i in range(len(shares(F.lit(""))))]
    met = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("body")).join(few, F.col("id") == F.col("l_id")).orderBy(F.xxhash64("l_id"), F.xxhash64("body"), "quality").limit(sample)
    rows = met.select("quality", vector("body").alias("hashed"), *[c.alias(n) for c, n in zip(shares(F.col("body")), names, strict=True)]).toArrow()
    x = np.zeros((rows.num_rows, 2 * HASHED + len(names)), np.float32)
    at = 0
    # batch by batch, as a second and third copy of all features is most of what the driver's Python would hold
    for batch in rows.to_batches():
        for i, one in enumerate(batch.column("hashed")):
            x[at + i, : 2 * HASHED] = np.frombuffer(one.as_buffer(), np.float32)
        for k, n in enumerate(names):
            x[at : at + batch.num_rows, 2 * HASHED + k] = batch.column(n).to_numpy(zero_copy_only=False)
        at += batch.num_rows
    return x, np.asarray(rows["quality"]) == 1


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, score and predicted; underscored where docs has such names."""
    import pyarrow as pa

    names = docs.columns
    ranking = fit(*_labelled(docs, labels, text, doc_id, sample))
    hold, score, predicted = (free_name(names, x) for x in ("held_out", "score", "predicted"))
    if ranking is None:
        told = F.lit(KEEP_AT)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(ranking)

        def run(t, *some):
            found = pa.array(sent.value.scores(t, some))
            release()
            return found

        told = F.arrow_udf(run, "double")(text_of(text), *shares(text_of(text)))
    out = docs.select("*", held_out(F.col(doc_id)).alias(hold), told.alias(score))
    return out.withColumn(predicted, (F.col(score) >= KEEP_AT).cast("int"))


ship(__name__)
