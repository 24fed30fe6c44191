"""Approximate nearest neighbours by a forest of sorted hash strings.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part. The others are stored in shards, as they are read. In a shard each tree gives every vector a string of BITS signs of random projections, and keeps the strings
as one sorted array, whose common prefixes are the trie. A query descends to its longest matching prefix in
each tree and then all trees go up together, a bit at a time, until the ranges that share the
current prefix hold `reach` of the shard's strings over all trees. Those candidates are scored by the exact cosine, in double
precision and in one order of summation, so equal vectors score the same; ties go to the smaller id.

Work is dealt as in grid.py: each shard's arrays are built once and stored, and a task holds a block of queries and streams the shards of a strip, so that tasks grow with the blocks of queries, never with shards times blocks,
and no vector is shuffled. A task yields k rows a query. Of equal vectors a shard keeps
the rows of the k + 1 smallest ids, k rows an id, as no query can return others; a vector that a third of all rows share is a few rows.

`reach` is fitted: FIT_QUERIES rows drawn by hash get their true neighbours in one scan of all rows, and the least reach is taken at which
`recall` of these share the prefix that a query goes up to in a forest over SAMPLE rows (FIT_BYTES of them at most), drawn by hash too. Nearer neighbours need less reach, so a denser table is searched by a smaller share.
Every vector is indexed. Rows that repeat an id are scored each; a query that repeats whole is asked once, and different vectors of one query id share its k places.
A null id takes no part. An empty table gives an empty result. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stash
from .grid import BLOCK, against, matrix, write_shards

TREES, BITS, SAMPLE = 160, 20, 16384
FIT_QUERIES, FIT_BYTES, RECALL = 128, 32 << 20, 0.94
#: Trees hashed, and queries looked up, at once.
_TREES, _QUERIES = 8, 256


def signs(x: np.ndarray, trees: int, bits: int, seed: int = 5) -> np.ndarray:
    """A string of bits as one number, for each tree (rows) and vector."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * bits))
    weights = 2.0 ** np.arange(bits - 1, -1, -1)
    out = np.empty((trees, len(x)), dtype=np.uint32)
    for t in range(0, trees, _TREES):
        up = x @ planes[:, t * bits : (t + _TREES) * bits] >= 0
        out[t : t + _TREES] = (up.reshape(len(x), -1, bits) @ weights).T.astype(np.uint32)
    return out


class Forest:
    """Sorted arrays of the strings (trees by rows) and the rows' places in that order."""

    def __init__(self, order: np.ndarray, strings: np.ndarray, bits: int):
        self.order, self.strings, self.bits = order, strings, bits

    @classmethod
    def grow(cls, x: np.ndarray, trees: int, bits: int) -> Forest:
        codes = signs(x, trees, bits)
        order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        return cls(order, np.take_along_axis(codes, order, axis=1), bits)

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lo, hi by prefix length, tree and query: the run of strings that share each prefix with the query."""
        trees, n = self.strings.shape
        lo = np.zeros((self.bits + 1, trees, codes.shape[1]), dtype=np.int32)
        hi = np.full_like(lo, n)
        for b in range(1, self.bits + 1):
            drop = np.uint32(self.bits - b)
            first = (codes >> drop) << drop
            last = first + ((np.uint32(1) << drop) - np.uint32(1))
            for t in range(trees):
                lo[b, t] = np.searchsorted(self.strings[t], first[t])
                hi[b, t] = np.searchsorted(self.strings[t], last[t], side="right")
        return lo, hi

    def levels(self, lo: np.ndarray, hi: np.ndarray, reach: float, own: np.ndarray) -> np.ndarray:
        """Per query the longest prefix length at which the runs of all trees hold enough, besides the query's own rows (own: how many it has here)."""
        trees, n = self.strings.shape
        enough = (hi - lo).sum(axis=1, dtype=np.int64) - own * trees >= np.minimum(1.0, reach) * (n - own) * trees
        return self.bits - np.argmax(enough[::-1], axis=0)

    def candidates(self, codes: np.ndarray, reach: float, own: np.ndarray) -> Iterator[np.ndarray]:
        """Per query the places of its candidates: descend, then go up in all trees at once until the runs hold enough."""
        trees, n = self.strings.shape
        seen = np.zeros(n, dtype=bool)
        for at in range(0, codes.shape[1], _QUERIES):
            lo, hi = self.ranges(codes[:, at : at + _QUERIES])
            for j, b in enumerate(self.levels(lo, hi, reach, own[at : at + _QUERIES])):
                for t in range(trees):
                    seen[self.order[t, lo[b, t, j] : hi[b, t, j]]] = True
                found = np.flatnonzero(seen)
                seen[found] = False
                yield found


def cosine(a: np.ndarray, b: np.ndarray, a_norm, b_norm) -> np.ndarray:
    return (a * b).sum(axis=-1) / (a_norm * b_norm)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


def times_in(ids: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How often each asked id is among ids, which are in order."""
    return np.searchsorted(ids, asked, side="right") - np.searchsorted(ids, asked)


def search(ids, x, forest: Forest, query_ids, queries, k: int, reach: float):
    """(query, id, score) arrays of each query's k nearest found here, and how many rows were scored; a query's own rows are no candidates of it."""
    size, trees, out, scored = norms(x), forest.strings.shape[0], [], 0
    for j, near in enumerate(forest.candidates(signs(queries, trees, forest.bits), reach, times_in(ids, query_ids))):
        near = near[ids[near] != query_ids[j]]
        scored += len(near)
        score = cosine(x[near], queries[j], size[near], norms(queries[j]))
        best = np.lexsort((ids[near], -score))[:k]
        out.append((np.full(len(best), query_ids[j]), ids[near][best], score[best]))
    return ([np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], dtype=t) for t in ("int64", "int64", "float64")]), scored


def few_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places, in order of id, of the rows that a search for k can return: of equal vectors the k + 1 smallest ids, k rows of each."""
    x = np.ascontiguousarray(x + 0.0)
    _, same = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    start = lambda new: np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    new = np.concatenate([[True], s[1:] != s[:-1]])
    new_id = new | np.concatenate([[True], i[1:] != i[:-1]])
    number = np.cumsum(new_id)
    keep = (number - number[start(new)] <= k) & (np.arange(len(s)) - start(new_id) < k)
    kept = order[keep]
    return kept[np.argsort(ids[kept], kind="stable")]


def fit_reach(sample: np.ndarray, sample_ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, near: np.ndarray, of: np.ndarray, recall: float, trees: int, bits: int) -> float:
    """The least share of strings to gather such that at least `recall` of the true neighbours (near, of the queries numbered in `of`) share a prefix as long as the query's
    level in a forest over the sample."""
    if not len(near) or not len(sample):
        return 1.0
    forest = Forest.grow(sample, trees, bits)
    codes, theirs = signs(asked, trees, bits), signs(near, trees, bits)
    apart = codes[:, of] ^ theirs
    shared = np.full(apart.shape[1], 0)
    for b in range(1, bits + 1):
        shared[((apart >> np.uint32(bits - b)) == 0).any(axis=0)] = b
    lo, hi = forest.ranges(codes)
    own = times_in(sample_ids, asked_ids)
    reach = 0.0002
    while reach < 1.0:
        if (shared >= forest.levels(lo, hi, reach, own)[of]).mean() >= recall:
            return reach
        reach *= 1.1
    return 1.0


def usable(rows: DataFrame, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda e: e.cast("double"))
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return rows.withColumn(vector, v).where(F.coalesce(good, F.lit(False)))


def _true_neighbours(good: DataFrame, asked: np.ndarray, asked_ids: np.ndarray, k: int, dim: int):
    """Places in asked, and vectors, of the k nearest rows of each of a few queries: one scan, k rows a query and batch, then k a query."""
    sent = good.sparkSession.sparkContext.broadcast((asked, asked_ids))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        q, q_ids = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            score = (x @ q.T) / np.outer(norms(x), norms(q))
            score[ids[:, None] == q_ids[None, :]] = -9
            best = np.argsort(-score, axis=0, kind="stable")[:k].T
            of = np.repeat(np.arange(len(q)), best.shape[1])
            rows, got = best.ravel(), score[best.ravel(), of]
            keep = got > -9
            yield pa.RecordBatch.from_arrays([pa.array(of[keep]), pa.array(ids[rows[keep]]), pa.array(got[keep]), pa.array(list(x[rows[keep]]), pa.list_(pa.float64()))], names=["of", "id", "score", "v"])

    best = Window.partitionBy("of").orderBy(F.desc("score"), "id")
    met = good.select("vec_id", "v").mapInArrow(scan, "of long, id long, score double, v array<double>")
    found = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("of", "v").toArrow()
    return found["of"].to_numpy(), matrix(found["v"].combine_chunks(), dim)


def nearest(rows: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", dim: int | None = None, recall: float = RECALL, trees: int = TREES, bits: int = BITS, shard: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query (a Column) marks, among all other rows."""
    return searched(rows, is_query, k, vec_id, vector, dim, recall, trees, bits, shard, block)[0]


def searched(rows: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", dim: int | None = None, recall: float = RECALL, trees: int = TREES, bits: int = BITS, shard: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The result of nearest, and a row a shard and block: queries, rows and how many pairs of them were scored."""
    spark = rows.sparkSession
    good = usable(rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")), "v").where(F.col("vec_id").isNotNull())
    if dim is None:
        dim = good.agg(F.mode(F.size("v"), True)).first()[0]
    if dim is None:
        return spark.sql("SELECT 0L AS query_id, 0 AS rank, 0L AS vec_id, 0D AS score WHERE false"), spark.sql("SELECT 0L AS queries, 0L AS rows, 0L AS scored WHERE false")
    good = good.where(F.size("v") == dim)
    asked = stash(good.where("q").select("vec_id", "v").dropDuplicates(["vec_id", "v"]).withColumn("key", F.xxhash64("vec_id", "v")), "ann-queries")

    def drawn(seed, most):
        found = good.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id", "v").limit(most).select("vec_id", "v").toArrow()
        return found["vec_id"].to_numpy(), matrix(found["v"].combine_chunks(), dim)

    asked_ids, asked_v = drawn(13, FIT_QUERIES)
    sample_ids, sample = drawn(1, max(1, min(shard or SAMPLE, FIT_BYTES // (8 * dim))))
    own = few_copies(sample_ids, sample, k) if len(sample) else []
    of, near = _true_neighbours(good, asked_v, asked_ids, k, dim)
    reach = fit_reach(sample[own], sample_ids[own], asked_v, asked_ids, near, of, recall, trees, bits)

    def plant(part):
        ids, x = part["vec_id"].to_numpy(), matrix(part["v"].combine_chunks(), dim)
        kept = few_copies(ids, x, k)
        forest = Forest.grow(x[kept], trees, bits)
        return {"ids": ids[kept], "x": x[kept], "order": forest.order, "strings": forest.strings}

    shards, folder = write_shards(good.select("vec_id", "v"), dim, plant, "ann", shard)

    def run(part, strip: Iterator):
        import pyarrow as pa

        q_ids, q = part["vec_id"].to_numpy(), matrix(part["v"].combine_chunks(), dim)
        best, told = [np.zeros(0, dtype=t) for t in ("int64", "int64", "float64")], []
        for s in strip:
            found, scored = search(s["ids"], s["x"], Forest(s["order"], s["strings"], bits), q_ids, q, k, reach)
            told.append((len(q_ids), len(s["ids"]), scored))
            best = [np.concatenate(c) for c in zip(best, found, strict=True)]
            order = np.lexsort((best[1], -best[2], best[0]))
            best = [c[order] for c in best]
            keep = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
            best = [c[keep] for c in best]
        n, m = len(best[0]), len(told)
        columns = [pa.chunked_array([pa.array(c, t), pa.nulls(m, t)]) for c, t in zip(best, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
        columns += [pa.chunked_array([pa.nulls(n, pa.int64()), pa.array([x[i] for x in told], pa.int64())]) for i in range(3)]
        return pa.table(columns, names=["query_id", "vec_id", "score", "queries", "rows", "scored"])

    schema = "query_id long, vec_id long, score double, queries long, rows long, scored long"
    found = stash(against(asked, "key", asked.count(), shards, folder, run, schema, block), "ann-found")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.where("scored is null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return top, found.where("scored is not null").select("queries", "rows", "scored")


ship(__name__)
