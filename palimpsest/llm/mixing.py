"""Mixing sources to target weights by pivotal dependent rounding.

A source's size is the number of words of its texts; `share` times all sizes is dealt to the sources by
weight, no source gets more than `cap` times its size, and what a capped source leaves is dealt again by
weight until none is above. Each document of a source is then to be copied target / size times: its
whole part for sure and its fraction by pivotal rounding. Two fractional documents meet, words move from one to the
other until one has a whole number of copies, with the two outcomes weighted so that each keeps its
expectation; the words of a source stay the same at each step, so its sum ends within one document of its
target. Chunks of a source are rounded by themselves, each leaving at most one fractional document, and
those meet again in a reduction tree, FAN chunks at a time, until one per source is left, which is
rounded by a coin of its own.

Coins are hashes of (seed, doc_id, text), so reruns agree on any cluster. Of rows that repeat whole, t with a fraction f, floor(t * f) take one copy more, one other has the rest as its
fraction, and the copies are dealt to them by number; which of them come first makes no difference. A null text or one without words has size 0 and zero copies; a text of any length is counted whole. A null source is a source of its own,
last in order. Equal coins are ordered by the row's hashes. An empty table gives an empty result. Extra columns pass through, also those named like columns used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, hash128, ship, stash, text_of

#: Rows that one task rounds in order, and chunks that meet at a node of the tree.
CHUNK, FAN = 1000, 256
WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, 17


def words_in(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds pos and target by water-filling.

    A round caps every source above cap times its size and deals the rest again; sources that can
    take a positive share only number as many as the distinct ratio of size to weight, so the level is found exactly by a
    window over sources sorted by that ratio: those with the least size per weight are capped first.
    The windows run over sources in one task, a row each: labels of a corpus, not rows. Millions of sources (domains, say) take seconds there; beyond that, group them first.
    """
    from pyspark.sql import Window

    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights)).cast("int"))
    ranked = sizes.withColumn("pos", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("room", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("room") / F.col("weight"), "pos")
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("before", F.coalesce(F.sum("room").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("pool", F.sum("source_size").over(every) * share)
        .withColumn("level", (F.col("pool") - F.col("before")) / F.col("left"))
        .withColumn("capped", F.col("level") * F.col("weight") > F.col("room"))
        .withColumn("last", F.min(F.when(~F.col("capped"), F.struct(F.col("room") / F.col("weight"), "pos", "level"))).over(every)["level"])
    )
    return filled.select("source", "pos", "source_size", F.when(F.col("last").isNull(), F.col("room")).otherwise(F.least(F.col("room"), F.col("last") * F.col("weight"))).alias("target"))


def pivot(mass: list[float], size: list[float], coin: list[float], eps: float = 1e-9):
    """Copies 0 or 1 (-1: the one row left over) and the leftover's fraction; words sum(mass * size) are kept."""
    out, held, p = [0] * len(mass), -1, 0.0
    for i, (q, s) in enumerate(zip(mass, size, strict=True)):
        if q <= eps or q >= 1 - eps:
            out[i] = int(q > 0.5)
            continue
        if held < 0:
            held, p = i, q
            continue
        big, small = size[held], s
        up = min((1 - p) * big, q * small)  # words that may go to the held one
        down = min(p * big, (1 - q) * small)
        move = up if coin[i] * (up + down) < down else -down
        p, q = p + move / big, q - move / small
        if not eps < q < 1 - eps:
            out[i] = int(q > 0.5)
            if not eps < p < 1 - eps:
                out[held], held = int(p > 0.5), -1
        else:
            out[held] = int(p > 0.5)
            held, p = i, q
    if held >= 0:
        out[held] = -1
    return out, p


def _round(frame):
    frame = frame.sort_values(["coin", "k1", "k2"], kind="stable")
    done, rest = pivot(frame["frac"].tolist(), frame["mass"].tolist(), frame["coin"].tolist())
    frame = frame.assign(extra=done)
    frame.loc[frame["extra"] == -1, "frac"] = rest
    return frame


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies * size); underscored where docs has such names."""
    names = docs.columns
    t1, t2 = hash128(text_of(text))
    rows = docs.select(F.col(source).alias("source"), words_in(text_of(text)).alias("size"), F.xxhash64(F.col(doc_id), t1, F.col(source), F.col(source).isNull()).alias("k1"), F.xxhash64(F.lit(3), F.col(doc_id), t2, F.col(source), F.col(source).isNull()).alias("k2"))
    units = stash(rows.groupBy("source", "k1", "k2", "size").agg(F.count("*").alias("times")), "mix-units")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("units"))
    plan = stash(source_targets(sums.select("source", "source_size"), weights, share, cap).join(sums.select(F.col("source").alias("s"), "units"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-plan")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("units") / CHUNK)).cast("long")
    unit = (
        units.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("base", F.floor(rate + 1e-12).cast("int"))
        .withColumn("part", F.when(F.col("size") > 0, F.greatest(rate - F.col("base"), F.lit(0.0)) * F.col("times")).otherwise(0.0))
        .withColumn("more", F.floor(F.col("part") + 1e-12))
        .withColumn("frac", F.greatest(F.col("part") - F.col("more"), F.lit(0.0)))
        .withColumn("mass", F.col("size").cast("double"))
        .withColumn("coin", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), F.lit(1 << 52)) / float(1 << 52))
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed + 1), "k1"), chunks))
        .select("pos", "source_size", "target", "size", "k1", "k2", "times", "base", "more", "frac", "mass", "coin", "chunk", F.lit(0).alias("extra"))
    )
    decided, level, most = None, unit, plan.agg(F.max(F.ceil(F.col("units") / CHUNK))).first()[0] or 1
    while True:
        level = stash(level.groupBy("pos", "chunk").applyInPandas(_round, level.schema), "mix-level")
        done = level.where("extra >= 0")
        decided = done if decided is None else decided.unionByName(done)
        level = level.where("extra < 0").withColumns({"chunk": F.floor(F.col("chunk") / FAN), "extra": F.lit(0), "coin": F.pmod(F.xxhash64(F.lit(seed), "k2", "k1"), F.lit(1 << 52)) / float(1 << 52)})
        if most <= 1:
            break
        most = -(-most // FAN)
    decided = decided.unionByName(level.withColumn("extra", (F.col("coin") < F.col("frac")).cast("int")))
    n, total, target, copies, taken = (free_name(names, x) for x in ("size", "source_size", "target", "copies", "taken"))
    d1, d2, d_size, d_total, d_target, d_copies, d_times, d_more = (free_name(names, x) for x in ("d1", "d2", "d_size", "d_total", "d_target", "d_copies", "d_times", "d_more"))
    told = decided.select(F.col("k1").alias(d1), F.col("k2").alias(d2), F.col("size").alias(d_size), F.col("source_size").cast("long").alias(d_total), F.col("target").alias(d_target), F.col("base").cast("int").alias(d_copies), F.col("times").alias(d_times), (F.col("more") + F.col("extra")).alias(d_more))
    key1 = F.xxhash64(F.col(doc_id), t1, F.col(source), F.col(source).isNull())
    key2 = F.xxhash64(F.lit(3), F.col(doc_id), t2, F.col(source), F.col(source).isNull())
    joined = docs.join(told, (key1 == F.col(d1)) & (key2 == F.col(d2)))
    repeated = told.where(F.col(d_times) > 1)
    if repeated.isEmpty():
        joined = joined.withColumn(d_copies, (F.col(d_copies) + F.col(d_more)).cast("int"))
    else:
        joined = _dealt(joined, names, d1, d2, d_copies, d_times, d_more)
    return joined.select(
        *[F.col(f"`{c}`") for c in names],
        F.col(d_size).alias(n),
        F.col(d_total).alias(total),
        F.col(d_target).alias(target),
        F.when(F.col(d_size) > 0, F.col(d_copies)).otherwise(0).alias(copies),
        F.when(F.col(d_size) > 0, F.col(d_copies) * F.col(d_size)).otherwise(F.lit(0)).cast("long").alias(taken),
    )


def _dealt(joined: DataFrame, names, d1: str, d2: str, d_copies: str, d_times: str, d_more: str) -> DataFrame:
    """d_copies of each row where rows repeat: the first d_more of equal ones get one more. Rows are numbered within the pieces of files that they are read from, and pieces by sums over them, so equal rows,
    be they a third of all, never meet in one task."""
    from pyspark.sql import Window

    piece, number, before = (free_name([*joined.columns], x) for x in ("d_piece", "d_number", "d_before"))
    rows = stash(joined, "mix-rows").withColumn(piece, F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    many = rows.where(F.col(d_times) > 1)
    each = many.groupBy(d1, d2, piece).agg(F.count("*").alias(before))
    each = each.withColumn(before, F.coalesce(F.sum(before).over(Window.partitionBy(d1, d2).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = many.withColumn(number, F.row_number().over(Window.partitionBy(d1, d2, piece).orderBy(F.lit(0))))
    own = within.join(each, [d1, d2, piece])
    extra = (F.col(number) + F.col(before) <= F.col(d_more)).cast("int")
    one = rows.where(F.col(d_times) <= 1)
    out = [*[F.col(f"`{c}`") for c in names], *[F.col(c) for c in joined.columns[len(names) :] if c != d_copies]]
    return one.select(*out, (F.col(d_copies) + F.col(d_more)).cast("int").alias(d_copies)).union(own.select(*out, (F.col(d_copies) + extra).cast("int").alias(d_copies)))


ship(__name__)
