"""Compression of vectors to codes: each part of a vector is replaced by the number of the nearest entry of that part's codebook.

Components become integers, floor(scale * x), and everything that decides is an exact integer: squared distances, sums, floored means. The codebooks start
as the parts of the vectors with the smallest ids. In each round all parts are assigned to their nearest entries (ties to the lower index), and
each entry becomes the floored mean of its parts; entries without parts stay. Then parts are assigned once more.

Assignment is Hamerly's: each part carries an upper bound on the distance to its entry and one lower bound on the distance to any other. After entries have moved, the upper bound
grows by its entry's way and the lower one shrinks by the longest way of another entry. Where the upper bound is strictly below the lower one, or below half the way from its entry to the nearest other,
the entry is still the only nearest. Else the upper bound is measured anew, and where it still isn't strictly below, all entries are
scanned in integers. Bounds are widened by SLACK, far more than rounding can take, so that a tie always comes to a scan and goes to the lower index.

A round is one pass over a table of rows with their bounds, written to the shared folder, without a shuffle: what parts have moved from entry to entry is added up by each task and then
over tasks, and the driver holds the codebooks and their sums (parts x entries x width numbers). The table of a round is erased when the next one is there.

Rows whose vector is null or holds null or non-finite components take no part, nor do vectors of another length than `dim`: the most frequent length that the parts divide
(the smaller, if two are as frequent). Fewer rows than entries: as many entries as rows. Ids that repeat are rows each, in order of
their vectors where the codebook starts; null ids come last there. Integers beyond limit(dim) of common.py count as that. A null label is a label. An empty table gives an empty result.
Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import erase, finite, integers, put, ship

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SLACK = 1e-9
#: Numbers of a matrix of distances at once.
_CELLS = 1 << 21


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows x to rows c: by products of doubles while all of them are whole numbers below 2^53, else in 64 bits."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if (2 * most) ** 2 * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for k, entry in enumerate(c):
        out[:, k] = own_squared(x, entry)
    return out


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    apart = x - c
    return (apart * apart).sum(axis=1)


class Codebook:
    """The entries of one part, how far they have moved since the last assignment, and how near they are to each other."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        way = np.zeros(len(now)) if before is None else np.sqrt(own_squared(now, before)) * (1 + SLACK)
        self.way = way
        far = np.argsort(-way, kind="stable")
        # the longest way of any other entry
        self.other_way = np.full(len(now), way[far[0]])
        self.other_way[far[0]] = way[far[1]] if len(now) > 1 else 0.0
        apart = np.sqrt(squared(now, now)) * (1 - SLACK)
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry, bound above on its distance, bound below on the second nearest."""
        code, upper, lower = np.empty(len(x), dtype=np.int16), np.empty(len(x)), np.full(len(x), np.inf)
        step = max(1, _CELLS // len(self.now))
        for at in range(0, len(x), step):
            d = squared(x[at : at + step], self.now)
            rows = np.arange(len(d))
            best = d.argmin(axis=1)  # the first of equal ones
            code[at : at + step] = best
            upper[at : at + step] = np.sqrt(d[rows, best]) * (1 + SLACK)
            if d.shape[1] > 1:
                d[rows, best] = np.iinfo(np.int64).max
                lower[at : at + step] = np.sqrt(d.min(axis=1)) * (1 - SLACK)
        return code, upper, lower

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Update the assignment in place; the number of full scans."""
        upper += self.way[code]
        upper *= 1 + SLACK
        lower -= self.other_way[code]
        lower -= np.abs(lower) * SLACK
        least = np.maximum(lower, self.half[code])
        open_ = np.flatnonzero(~(upper < least))
        upper[open_] = np.sqrt(own_squared(x[open_], self.now[code[open_]])) * (1 + SLACK)
        open_ = open_[~(upper[open_] < least[open_])]
        code[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return len(open_)


def _flat(column, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(dtype)


def _pass(rows: DataFrame, label_type, books: list[tuple[np.ndarray, np.ndarray | None]], first: bool, last: bool):
    """Assign all parts once. A result row is a vector with its bounds (or, at last, with its error), or, with `part` set, what a task adds to an entry: n and sums."""
    parts, entries, width = len(books), *books[0][0].shape
    sent = rows.sparkSession.sparkContext.broadcast(books)
    head = [T.StructField("vec_id", T.LongType()), T.StructField("label", label_type)]
    kept = [("code", T.BinaryType()), ("error", T.LongType())] if last else [("q", T.ArrayType(T.LongType())), ("code", T.ArrayType(T.ShortType())), ("upper", T.ArrayType(T.DoubleType())), ("lower", T.ArrayType(T.DoubleType()))]
    told = [("part", T.IntegerType()), ("entry", T.IntegerType()), ("n", T.LongType()), ("sums", T.ArrayType(T.LongType())), ("scans", T.LongType())]
    schema = T.StructType(head + [T.StructField(*x) for x in kept + told])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        nulls = lambda names, n: [pa.nulls(n, shape.field(c).type) for c in names]
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), kind))
        books = [Codebook(*b) for b in sent.value]
        n, sums, scans = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            q = _flat(column["q"], parts * width, np.int64)
            code, upper, lower = (np.zeros((len(q), parts), dtype=t) for t in ("int16", "float64", "float64")) if first else (_flat(column[c], parts, t) for c, t in (("code", "int16"), ("upper", "float64"), ("lower", "float64")))
            error = np.zeros(len(q), dtype=np.int64)
            for p, book in enumerate(books):
                x = q[:, p * width : (p + 1) * width]
                was = code[:, p].copy()
                own = [was.copy(), upper[:, p].copy(), lower[:, p].copy()]
                if first:
                    own, moved = book.scan(x), np.arange(len(x))
                    scans += len(x)
                else:
                    scans += book.again(x, *own)
                    moved = np.flatnonzero(own[0] != was)
                    np.subtract.at(sums[p], was[moved], x[moved])
                    np.subtract.at(n[p], was[moved], 1)
                code[:, p], upper[:, p], lower[:, p] = own
                np.add.at(sums[p], code[moved, p], x[moved])
                np.add.at(n[p], code[moved, p], 1)
                if last:
                    error += own_squared(x, book.now[code[:, p]])
            if last:
                held = [pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()), pa.array(error)]
            else:
                held = [lists(q, pa.int64()), lists(code, pa.int16()), lists(upper, pa.float64()), lists(lower, pa.float64())]
            yield pa.RecordBatch.from_arrays([column["vec_id"], column["label"], *held, *nulls([c for c, _ in told], len(q))], schema=shape)
        p, e = np.nonzero((n != 0) | (sums != 0).any(axis=2))
        # the number of scans stands in a row of its own, of part -1
        out = [pa.array(np.append(p, -1), pa.int32()), pa.array(np.append(e, 0), pa.int32()), pa.array(np.append(n[p, e], 0)), lists(np.concatenate([sums[p, e], np.zeros((1, width), dtype=np.int64)]), pa.int64()), pa.array(np.append(np.zeros(len(p), dtype=np.int64), scans))]
        yield pa.RecordBatch.from_arrays([*nulls(["vec_id", "label", *[c for c, _ in kept]], len(p) + 1), *out], schema=shape)

    return rows.mapInArrow(run, schema)


def _moved(table: DataFrame, n: np.ndarray, sums: np.ndarray) -> int:
    """Add what the tasks of a round tell, at most one row an entry and task, to the counts and sums; the number of full scans."""
    told = table.where("part is not null")
    each = told.where("part >= 0").select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
    wide = T.DecimalType(38, 0)
    for r in each.groupBy("part", "entry", "at").agg(F.sum(F.col("sum").cast(wide)).alias("sum"), F.sum("n").alias("n")).toLocalIterator():
        sums[r["part"], r["entry"], r["at"]] += int(r["sum"])
        if r["at"] == 0:
            n[r["part"], r["entry"]] += r["n"]
    return told.where("part = -1").agg(F.sum("scans")).first()[0] or 0


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (hex, two digits a part), error, label_error (error summed over rows of that label), codebooks_sha256."""
    return compressed(rows, vec_id, vector, label, parts, entries, rounds, scale)[0]


def compressed(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """The result of compress, the codebooks, and how many parts each assignment scanned in full."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte")
    label_type = rows.schema[label].dataType
    good = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(finite(F.col("v")))
    dim = good.where((F.size("v") % parts == 0) & (F.size("v") > 0)).agg(F.mode(F.size("v"), True)).first()[0]
    if dim is None:
        return good.limit(0).select("vec_id", "label", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256")), [], []
    state = good.where(F.size("v") == dim).select("vec_id", "label", integers(F.col("v"), scale, dim).alias("q"))
    start = np.array([r["q"] for r in state.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()], dtype=np.int64)
    books = list(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2))
    n, sums = np.zeros((parts, len(start)), dtype=object), np.zeros((parts, len(start), dim // parts), dtype=object)
    before, folder, scans = [None] * parts, None, []
    for step in range(rounds + 1):
        last = step == rounds
        table, path = put(_pass(state, label_type, list(zip(books, before, strict=True)), step == 0, last), "codes")
        if folder:
            erase(folder, rows.sparkSession)
        state, folder = table.where("part is null"), path
        if last:
            scans.append(table.where("part = -1").agg(F.sum("scans")).first()[0] or 0)
            break
        scans.append(_moved(table, n, sums))
        before, books = books, [np.where(n[p][:, None] > 0, sums[p] // np.maximum(n[p], 1)[:, None], books[p]).astype(np.int64) for p in range(parts)]
    told = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    own = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    by_label = own.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    out = own.join(by_label, F.col("label").eqNullSafe(F.col("l")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256")), books, scans


ship(__name__)
