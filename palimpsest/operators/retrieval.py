"""Retrieval: exact cosine top-k with a metadata filter, rank fusion, and lexical relevance by inverse document frequency."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RRF_K
from ..functions.shared import ship, shared_dir, stored
from ..functions.text import clamp, rounded


#: Bytes of vectors that a task holds at once, of queries in a stored shard, and of scores that are made at once.
STRIP, SENT, SCORED = 32 << 20, 4 << 20, 64 << 20
#: Scores by blocked products differ from those that are summed in order by less than this.
SLACK = 1e-9


def _vectors_of(column) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the vectors: their rows, components in double precision, and which of them hold a null. Null vectors are left out."""
    at, size = column.offsets.to_numpy(), column.value_lengths().to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values
    # nulls come as NaN, as do NaN components; only the first are marked
    value, gap = flat.cast("double").to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    out = []
    for n in np.unique(size[there]).astype(int):
        rows = np.flatnonzero(there & (size == n))
        place = at[rows][:, None] + np.arange(n)
        out.append((rows, value[place], gap[place].any(axis=1) if gap is not None else np.zeros(len(rows), bool)))
    return out


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x and y, component by component from the first."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


class _Side:
    """Vectors of one length: ids, components, norms, unit vectors, and what has no plain score."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, gap: np.ndarray):
        self.ids, self.x, self.gap, self.norm = ids, x, gap, np.sqrt(_summed(x, x))
        # a square that overflows, or one so small that precision is lost, has no unit vector of use
        self.odd = ~np.isfinite(self.norm) | gap | ((self.norm < 1e-140) & (self.norm > 0)) | ~np.isfinite(x).all(axis=1)
        with np.errstate(all="ignore"):
            self.unit = np.where((self.odd | (self.norm == 0))[:, None], 0.0, x / self.norm[:, None])


def _scores(v: _Side, q: _Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of vectors i and queries j, and which of them are null."""
    with np.errstate(all="ignore"):
        whole = v.norm[i] * q.norm[j]
        score = _summed(v.x[i], q.x[j]) / whole
    gap = v.gap[i] | q.gap[j]
    zero = ((v.norm[i] == 0) & ~v.gap[i]) | ((q.norm[j] == 0) & ~q.gap[j])
    none = (gap | (whole == 0)) & ~zero
    return np.where(zero, 0.0, score), none


def _best(v: _Side, q: _Side, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Query, id, score and whether it is null of each query's k best of the vectors v, ties to the smaller id."""
    # what has no plain score raises no bar, and is scored with every query, or with every vector
    odd = np.flatnonzero(v.odd)
    step = max(1, SCORED // (8 * max(len(v.ids), 1)))
    for start in range(0, len(q.ids), step):
        some = np.arange(start, min(start + step, len(q.ids)))
        near = q.unit[some] @ v.unit.T
        near[:, odd] = -np.inf
        if len(v.ids) > k:
            bar = np.partition(near, len(v.ids) - k, axis=1)[:, len(v.ids) - k] - SLACK
            hit = near >= bar[:, None]
            hit[:, odd] = True
            hit[q.odd[some]] = True
        else:
            hit = np.ones(near.shape, bool)
        at, i = np.nonzero(hit)
        for lo, hi in _pieces(at, max(1, SCORED // (32 * max(v.x.shape[1], 1)))):
            j, which = some[at[lo:hi]], i[lo:hi]
            score, none = _scores(v, q, which, j)
            # nulls last, NaN first, as Spark orders them
            rank = np.where(none, -np.inf, np.where(np.isnan(score), np.inf, score))
            order = np.lexsort((v.ids[which], -rank, ~np.isnan(score) | none, none, j))
            first = np.flatnonzero(np.append(True, j[order][1:] != j[order][:-1]))
            kept = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]
            yield q.ids[j[kept]], v.ids[which[kept]], score[kept], none[kept]


def _pieces(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole queries of at most so many pairs; a query of more is a run of its own."""
    lo = 0
    while lo < len(at):
        hi = len(at) if lo + most >= len(at) else int(np.searchsorted(at, at[lo + most], side="left"))
        hi = max(hi, int(np.searchsorted(at, at[lo], side="right")))
        yield lo, hi
        lo = hi


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, strip: int = STRIP, sent: int = SENT) -> DataFrame:
    """vectors (id, vector, ...), queries (query_id, vector): each query's k most similar vectors, ties to the smaller id. ids are whole numbers.

    The filter is applied first. Queries lie in stored shards of about `sent` bytes, and vectors stay where they are read: a task takes them in strips of at most `strip` bytes, and meets each strip with one shard after the
    other by matrix products. What comes within SLACK of a strip's k best is scored again by sums in order, and k rows a query and strip are shuffled.
    """
    spark = vectors.sparkSession
    v = (vectors if where is None else vectors.where(where)).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    folder = f"{shared_dir(spark)}/palimpsest-{spark.sparkContext.applicationId}/queries-{uuid.uuid4().hex}"

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs, ipc

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            if batch.num_rows:
                each = max(1, batch.num_rows * sent // max(batch.nbytes, 1))
                system.create_dir(root, recursive=True)
                for i in range(0, batch.num_rows, each):
                    name = uuid.uuid4().hex
                    with system.open_output_stream(f"{root}/{name}", compression=None) as out, ipc.new_stream(out, batch.schema) as to:
                        to.write_batch(batch.slice(i, each))
                    yield pa.RecordBatch.from_pydict({"name": [name]})

    size = queries.agg(F.coalesce(F.sum(F.size("vector") * 8 + 16), F.lit(0))).first()[0]
    parts = max(1, -(-size // sent))
    names = [r[0] for r in stored(q.repartition(parts, F.xxhash64("query_id")).mapInArrow(write, "name string"), "query-shards").collect()]

    def sides(batches: list) -> list[_Side]:
        import pyarrow as pa

        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column(0).to_numpy()
        return [_Side(ids[rows], x, gap) for chunk in table.column(1).chunks for rows, x, gap in _vectors_of(chunk)]

    def meet(held: list) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs, ipc

        system, root = fs.FileSystem.from_uri(folder)
        mine = sides(held)
        for name in names:
            with system.open_input_file(f"{root}/{name}") as f:
                asked = sides(list(ipc.open_stream(f)))
            for x in mine:
                for y in asked:
                    if x.x.shape[1] == y.x.shape[1]:
                        for query, found, score, none in _best(x, y, k):
                            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(score, mask=none, from_pandas=False)], names=["query_id", "id", "score"])

    def run(batches: Iterator) -> Iterator:
        held, bytes_ = [], 0
        for batch in batches:
            held.append(batch)
            bytes_ += batch.nbytes
            if bytes_ >= strip:
                yield from meet(held)
                held, bytes_ = [], 0
        if held:
            yield from meet(held)

    met = v.mapInArrow(run, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """lists (query_id, list, id, pos from 0): the sum of 1 / (k + pos + 1) over an id's first place in each list, and where it came from.

    Places are the original ones: an id that repeats counts once and what follows isn't moved up."""
    first = lists.groupBy("query_id", "list", "id").agg(F.min("pos").alias("pos"))
    out = first.groupBy("query_id", "id").agg(
        F.sum(F.when(F.col("list") == "keyword", 1.0 / (F.lit(k) + F.col("pos") + 1))).alias("kw"),
        F.sum(F.when(F.col("list") == "semantic", 1.0 / (F.lit(k) + F.col("pos") + 1))).alias("sem"),
    )
    tag = F.when(F.col("kw").isNull(), "semantic").when(F.col("sem").isNull(), "keyword").otherwise("both")
    return out.select("query_id", "id", (F.coalesce("kw", F.lit(0.0)) + F.coalesce("sem", F.lit(0.0))).alias("score"), tag.alias("source"))


def lexical_relevance(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """entries (id, tokens), queries (query_id, tokens): the share of a query's weight that an entry holds. A token weighs
    ln(1 + n / df) of the corpus, and ln(1 + n) where no entry holds it. Entries that name the query they are to be scored for (query_id) are scored for that one alone, which takes time in their number and not
    in that of pairs."""
    on = ["token", "query_id"] if "query_id" in entries.columns else ["token"]
    n = entries.agg(F.count("*").alias("n"))
    wanted = stored(queries.select("query_id", F.explode("tokens").alias("token")), "asked-tokens")
    # tokens are made once, and only those that a query asks for are kept, an entry's in one task, so that its sums are made there
    words = entries.select("id", *on[1:], F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    words = stored(words, "asked-words")
    df = stored(words.groupBy("token").agg(F.count("*").alias("df")), "asked-counts")
    asked = wanted.join(df, "token", "left").join(n)
    asked = stored(asked.withColumn("weight", F.when(F.col("df").isNull(), F.log1p("n")).otherwise(F.log1p(F.col("n") / F.col("df")))), "asked-weights")
    whole = asked.groupBy("query_id").agg(F.sum("weight").alias("whole"))
    hit = words.repartition("id").join(asked, on).groupBy("query_id", "id").agg(F.sum("weight").alias("held"), F.count("*").alias("shared"))
    return hit.join(whole, "query_id").select("query_id", "id", "shared", (F.col("held") / F.col("whole")).alias("score"))


def ranked_relevance(hits: DataFrame, hashes: DataFrame, most: int | None = None) -> DataFrame:
    """hits (query_id, id, score) with the score clamped and rounded to four places, and its rank: by score, then by the text's hash (hashes: id, hash), then by id. most: the last rank that is wanted; then only what can
    have it by its score is joined to its hash."""
    scored = hits.withColumn("score", rounded(clamp(F.col("score")), 4))
    if most is not None:
        scored = scored.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("rank") <= most).drop("rank")
    scored = scored.join(hashes, "id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hash", "id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


ship(__name__)
