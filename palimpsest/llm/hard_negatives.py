"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels whose score is a given share of the positive's.

Components become integers, floor(scale * x), and a score is the integer inner product; ties go to the smaller id. An anchor's positives are its first `positives` other rows of the same label. For a
positive with score p the negatives are the first `negatives` rows of other labels with score n where low * p <= 100 * n <= high * p, in whole numbers (none, if p is negative).

The search is exact. All rows are turned once by an orthogonal matrix whose leading directions hold most of the table's squared length (the eigenvectors of the sum of outer products; about zero, not about the mean, as inner
products are). Products of anchors and rows accumulate over leading components in STAGES; what the rest can add is at most the product of the residual norms, and SLACK times the product of the norms
is put on top, far more than rounding can take. A pair leaves as soon as its bounds miss every window that is open for its anchor: the window of a positive
ends above at high * p and below at the k-th best score that was met so far, or low * p. Pairs that stay are verified with integer products, and only these count.

Work is dealt as in grid.py: shards of rows (turned, with residual norms) and blocks of anchors. First positives, then negatives; neither shuffles rows, only anchors and what was found for them.

Rows with a null label or a null vector, or that hold null or non-finite components, take no part, nor do null ids and vectors of another length than most. Rows that repeat are rows each,
but an anchor that repeats whole is asked once, and rows of the anchor's own id are no positives of it. Integers beyond limit(dim) of common.py count as that. Of equal vectors of one label a shard keeps the rows with the smallest ids, as many
as can be returned. An anchor alone in its label has no positives and so no rows. An empty table gives an empty result. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import few_copies
from .common import finite, integers, ship, stash
from .grid import BLOCK, against, matrix, write_shards

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Shares of the components after which pairs are looked at, and the slack of their bounds.
STAGES, SLACK = (0.125, 0.25, 0.5, 0.75, 1.0), 1e-9
#: Rows of a shard and pairs to verify at once, at most; both start small, so that floors rise before the many come.
_ROWS, _PAIRS, _FIRST = 4096, 1 << 16, 512
_NONE = np.iinfo(np.int64).min


def steps(dim: int) -> list[int]:
    return sorted({max(1, round(dim * s)) for s in STAGES})


def turn(q: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the turned directions, and for each step the norm of what comes after it; first the whole norm."""
    y = q.astype(np.float64) @ rotation
    after = np.sqrt(np.concatenate([np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(y), 1))], axis=1))
    return y, after[:, [0, *steps(q.shape[1])]]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def bounds(p: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers n with low * p <= 100 * n <= high * p, from the first to the second, without leaving 64 bits."""
    whole, rest = p // 100, p % 100
    return low * whole - (-low * rest) // 100, high * whole + (high * rest) // 100


def growing(n: int, first: int, most: int) -> Iterator[slice]:
    """Slices of n, each twice as long as the one before, up to most."""
    at = 0
    while at < n:
        yield slice(at, at + first)
        at, first = at + first, min(most, 2 * first)


class Found:
    """The first k rows of each window (anchor, window), as they are met."""

    def __init__(self, least: np.ndarray, most: np.ndarray, k: int):
        """least, most: by anchor and window, the scores that it takes."""
        self.least, self.most, self.k = least, most, k
        self.floor = least.copy()
        self.window, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        windows = self.least.shape[1]
        fits = (score[:, None] >= self.floor[anchor]) & (score[:, None] <= self.most[anchor])
        pair, window = np.nonzero(fits)
        if not len(pair):
            return
        w = np.concatenate([self.window, anchor[pair] * windows + window])
        s, i = np.concatenate([self.score, score[pair]]), np.concatenate([self.id, ids[pair]])
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        keep = rank < self.k
        full = rank == self.k - 1
        self.window, self.score, self.id = w[keep], s[keep], i[keep]
        self.floor.ravel()[w[full]] = s[full]


def meet(found: Found, q: np.ndarray, y: np.ndarray, after: np.ndarray, allowed: np.ndarray, r_q: np.ndarray, r_y: np.ndarray, r_after: np.ndarray, r_ids: np.ndarray) -> int:
    """Put rows to anchors; allowed: pairs that count. How many pairs were verified."""
    anchors, rows, done, partial, verified = np.arange(len(q)), np.arange(len(r_q)), 0, np.zeros(allowed.shape), 0
    floor, top = found.floor.min(axis=1).astype(np.float64), found.most.max(axis=1).astype(np.float64)
    last = steps(q.shape[1])
    for s, upto in enumerate(last, 1):
        partial += y[anchors, done:upto] @ r_y[rows, done:upto].T
        done = upto
        slack = SLACK * np.outer(after[anchors, 0], r_after[rows, 0]) + 1e-6
        rest = np.outer(after[anchors, s], r_after[rows, s]) + slack
        allowed = allowed & (partial + rest >= floor[anchors, None]) & (partial - rest <= top[anchors, None])
        if upto == last[-1]:
            break
        some_a, some_r = allowed.any(axis=1), allowed.any(axis=0)
        if not some_a.all() or not some_r.all():
            anchors, rows, allowed, partial = anchors[some_a], rows[some_r], allowed[np.ix_(some_a, some_r)], partial[np.ix_(some_a, some_r)]
        if not len(anchors):
            return 0
    a, r = np.nonzero(allowed)
    near, rest = partial[a, r], rest[a, r]
    a, r = anchors[a], rows[r]
    fits = ((near + rest)[:, None] >= found.floor[a]) & ((near - rest)[:, None] <= found.most[a])
    keep = fits.any(axis=1)
    # the best first, so that those after them meet a higher floor
    order = np.argsort(-near[keep], kind="stable")
    a, r, near, rest = a[keep][order], r[keep][order], near[keep][order], rest[keep][order]
    for cut in growing(len(a), _FIRST, _PAIRS):
        x, z = a[cut], r[cut]
        still = (((near + rest)[cut, None] >= found.floor[x]) & ((near - rest)[cut, None] <= found.most[x])).any(axis=1)
        x, z = x[still], z[still]
        found.add(x, products(q[x], r_q[z]), r_ids[z])
        verified += len(x)
    return verified


def search(block: dict, shards: Iterator[dict], k: int, same: bool, rotation: np.ndarray) -> tuple[Found, int, int]:
    """block: ids, labels, q, least, most by anchor. What was found, how many pairs were verified, and how many there are."""
    y, after = turn(block["q"], rotation)
    found, verified, pairs = Found(block["least"], block["most"], k), 0, 0
    for shard in shards:
        numbers = {x: i for i, x in enumerate(shard["names"].tolist())}
        own = np.array([numbers.get(x, -1) for x in block["labels"]])
        for cut in growing(len(shard["ids"]), _FIRST if found.window.size == 0 else _ROWS, _ROWS):
            alike = own[:, None] == shard["label"][cut][None, :]
            allowed = alike & (block["ids"][:, None] != shard["ids"][cut][None, :]) if same else ~alike
            pairs += int(allowed.sum())
            verified += meet(found, block["q"], y, after, allowed, shard["q"][cut], shard["y"][cut], shard["after"][cut], shard["ids"][cut])
    return found, verified, pairs


def main_directions(rows: DataFrame, dim: int) -> np.ndarray:
    """The eigenvectors of the sum of outer products of all rows (column q), the largest first. A task adds up its own; dim * dim numbers come to the driver."""

    def outer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column(0), dim)
                total += q.T @ q
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(dim * dim)), "x": pa.array(total.ravel())})

    total = np.zeros(dim * dim)
    for r in rows.select("q").mapInArrow(outer, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toLocalIterator():
        total[r["at"]] = r["x"]
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1].copy()


def mine(rows: DataFrame, is_anchor, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for each row that is_anchor (a Column) marks."""
    return mined(rows, is_anchor, vec_id, vector, label, positives, negatives, low, high, scale, block)[0]


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(rows: DataFrame, is_anchor, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """The result of mine, and a row a task of the search for negatives: pairs that count and pairs verified."""
    spark = rows.sparkSession
    good = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    good = good.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    dim = good.where(F.size("v") > 0).agg(F.mode(F.size("v"), True)).first()[0]
    if dim is None:
        return spark.createDataFrame([], OUT), None
    good = good.where(F.size("v") == dim).select("vec_id", "label", integers(F.col("v"), scale, dim).alias("q"), "asked")
    rotation = spark.sparkContext.broadcast(main_directions(good, dim))
    keeps = max(positives, negatives)

    def shard(part):
        import pyarrow as pa

        names, number = np.unique(np.array(part["label"].to_pylist()), return_inverse=True)
        q, ids = matrix(part["q"].combine_chunks(), dim, np.int64), part["vec_id"].to_numpy()
        # of equal vectors of a label more than these are never returned; one more, as an anchor's own id doesn't count
        own = few_copies(ids, np.column_stack([number, q]), keeps)
        y, after = turn(q[own], rotation.value)
        return {"ids": ids[own], "names": names, "label": number[own], "q": q[own], "y": y, "after": after}

    shards, folder = write_shards(good.select("vec_id", "label", "q"), dim, shard, "negatives")
    key = F.sha2(F.concat_ws(",", F.col("vec_id").cast("string"), F.concat_ws(",", F.col("q").cast("array<string>")), "label"), 256)
    anchors = stash(good.where("asked").select(key.alias("key"), "vec_id", "label", "q").dropDuplicates(["key"]), "anchors")
    n = anchors.count()

    def arrays(part) -> dict:
        return {"ids": part["vec_id"].to_numpy(), "labels": part["label"].to_pylist(), "q": matrix(part["q"].combine_chunks(), dim, np.int64)}

    def same(part, strip):
        import pyarrow as pa

        b = arrays(part)
        b["least"], b["most"] = np.full((len(part), 1), _NONE), np.full((len(part), 1), -(_NONE + 1))
        found, _, _ = search(b, strip, positives, True, rotation.value)
        return pa.table({"key": part["key"].combine_chunks().take(pa.array(found.window)), "id": pa.array(found.id), "score": pa.array(found.score)})

    met = against(anchors, "key", n, shards, folder, same, "key string, id long, score long", block)
    best = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    first = stash(met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives), "positives")
    asked = anchors.join(first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("p")), "key")

    def others(part, strip):
        import pyarrow as pa

        b = arrays(part)
        p = part["p"].to_pylist()
        count = np.array([len(x) for x in p])
        scores = np.array([[x[j]["score"] if j < len(x) else 0 for j in range(positives)] for x in p], dtype=np.int64)
        ids = np.array([[x[j]["id"] if j < len(x) else 0 for j in range(positives)] for x in p], dtype=np.int64)
        b["least"], b["most"] = bounds(scores, low, high)
        # windows that take nothing: below no score and above every one
        none = (np.arange(positives)[None, :] >= count[:, None]) | (b["least"] > b["most"])
        b["least"][none], b["most"][none] = -(_NONE + 1), _NONE
        found, verified, pairs = search(b, strip, negatives, False, rotation.value)
        a, j = found.window // positives, found.window % positives
        out = pa.table({"key": part["key"].combine_chunks().take(pa.array(a)), "anchor_id": pa.array(b["ids"][a]), "n": pa.array(j, pa.int64()), "positive_id": pa.array(ids[a, j]), "positive_score": pa.array(scores[a, j]), "negative_id": pa.array(found.id), "negative_score": pa.array(found.score), "pairs": pa.nulls(len(a), pa.int64()), "verified": pa.nulls(len(a), pa.int64())})
        told = {c: pa.nulls(1, t.type) for c, t in zip(out.schema.names, out.schema, strict=True)} | {"pairs": pa.array([pairs]), "verified": pa.array([verified])}
        return pa.concat_tables([out, pa.table(told)])

    schema = "key string, anchor_id long, n long, positive_id long, positive_score long, negative_id long, negative_score long, pairs long, verified long"
    found = stash(against(asked, "key", n, shards, folder, others, schema, block), "negatives-found")
    order = Window.partitionBy("key", "n").orderBy(F.desc("negative_score"), "negative_id")
    top = found.where("pairs is null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return top.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), found.where("pairs is not null").select("pairs", "verified")


ship(__name__)
