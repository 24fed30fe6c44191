"""Budgeted projection: score entries, keep the pinned, reserve the relevant, and fill the rest by an exact 0/1 knapsack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HALF_LIFE_DAYS, NEUTRAL_RECENCY, RESERVE_COUNT, RESERVE_MIN, VALUE_SCALE
from ..functions.shared import ship
from ..functions.text import clamp

#: Importance, recency, specificity, fit, pin, relevance.
W_IMPORTANCE, W_RECENCY, W_SPECIFICITY, W_FIT, W_PIN, W_RELEVANCE = 0.25, 0.15, 0.15, 0.10, 0.15, 0.20


def recency(day: Column, today: Column, half_life: int = HALF_LIFE_DAYS) -> Column:
    """Halves with each half-life; no date is neutral."""
    age = F.greatest(F.datediff(today, day), F.lit(0))
    decayed = F.when(age == 0, 1.0).otherwise(0.0) if half_life <= 0 else clamp(F.pow(F.lit(0.5), age / half_life))
    return F.when(day.isNull(), NEUTRAL_RECENCY).otherwise(decayed)


def dated(entries: DataFrame, current_facts: DataFrame, text_date: Column) -> DataFrame:
    """entries (ref, store, hash, key, ...) with day and day_source: of the store's current fact of the same content, else of the same key, else the text's latest date.

    current_facts: store, hash, fact_key, day; of several the latest counts. Two equi-joins on small rows."""
    by_hash = current_facts.where("day is not null").groupBy("store", "hash").agg(F.max("day").alias("_hash_day"))
    by_key = current_facts.where("day is not null").groupBy("store", F.col("fact_key").alias("key")).agg(F.max("day").alias("_key_day"))
    j = entries.withColumn("_text_day", text_date).join(by_hash, ["store", "hash"], "left").join(by_key, ["store", "key"], "left")
    source = F.when(F.col("_hash_day").isNotNull(), "temporal:hash").when(F.col("_key_day").isNotNull(), "temporal:key").when(F.col("_text_day").isNotNull(), "text-date").otherwise("neutral-default")
    return j.withColumn("day", F.coalesce("_hash_day", "_key_day", "_text_day")).withColumn("day_source", source).drop("_hash_day", "_key_day", "_text_day")


def relevant(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """entries (ref, hash) met by hits (query_id, ref, hash, score): query_id, ref, relevance and by what it was found, the content first, then the ref."""
    score = clamp(F.coalesce("score", F.lit(0.0)))
    by_hash = hits.where("hash is not null").groupBy("query_id", "hash").agg(F.max(score).alias("relevance"))
    by_ref = hits.where("ref is not null").groupBy("query_id", "ref").agg(F.max(score).alias("relevance"))
    first = entries.select("ref", "hash").join(by_hash, "hash").select("query_id", "ref", "relevance", F.lit("content_hash").alias("found_by"))
    second = entries.select("ref").join(by_ref, "ref").join(first.select("query_id", "ref"), ["query_id", "ref"], "left_anti")
    return first.unionByName(second.select("query_id", "ref", "relevance", F.lit("entry_ref").alias("found_by")))


def projection_score(importance: Column, recent: Column, specificity: Column, fit: Column, pinned: Column, relevance: Column) -> Column:
    pin = F.when(pinned, 1.0).otherwise(0.0)
    return clamp(W_IMPORTANCE * importance + W_RECENCY * recent + W_SPECIFICITY * specificity + W_FIT * fit + W_PIN * pin + W_RELEVANCE * relevance)


def reserve(candidates: DataFrame, count: int = RESERVE_COUNT, least: float = RESERVE_MIN) -> DataFrame:
    """candidates (grp, ref, tokens, relevance, score, room): of each group the most relevant, in turn, where they fit in what is left, `count` at most.

    A fold over the group's sorted candidates: one that doesn't fit is passed over, the next may fit. The list holds candidates over the threshold only."""
    item = F.struct((-F.col("relevance")).alias("r"), (-F.col("score")).alias("s"), "ref", "tokens")
    lists = candidates.where(F.col("relevance") >= least).groupBy("grp", "room").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<long>").alias("refs"))
    taken = F.aggregate("items", start, lambda a, x: F.when((F.size(a["refs"]) < count) & (a["used"] + x["tokens"] <= F.greatest(F.col("room"), F.lit(0))), F.struct((a["used"] + x["tokens"]).alias("used"), F.concat(a["refs"], F.array(x["ref"].cast("long"))).alias("refs"))).otherwise(a))
    return lists.select("grp", taken.alias("t")).select("grp", F.col("t.used").alias("used"), F.explode("t.refs").alias("ref"))


def best_subset(weights: list[int], values: list[int], capacity: int) -> list[int]:
    """Indices of the subset of most value within the capacity, by dynamic programming over capacities; where taking makes no difference an item is left."""
    import numpy as np

    if not weights or capacity <= 0:
        return []
    if sum(weights) <= capacity:
        return list(range(len(weights)))
    best = np.zeros(capacity + 1, dtype=np.int64)
    took = np.zeros((len(weights), capacity + 1), dtype=bool)
    for i, (w, v) in enumerate(zip(weights, values, strict=True)):
        if w <= capacity:
            with_it = best[: capacity + 1 - w] + v
            took[i, w:] = with_it > best[w:]
            best[w:] = np.maximum(best[w:], with_it)
    out, room = [], capacity
    for i in range(len(weights) - 1, -1, -1):
        if took[i, room]:
            out.append(i)
            room -= weights[i]
    return out[::-1]


def knapsack(items: DataFrame) -> DataFrame:
    """items (grp, ord, ref, tokens, score, room) -> grp, ref of each group's best subset.

    Of items of one weight only the best room / weight can be in it, the earlier where equal, so the others go before a group meets in a task; what is left of a
    group of any size is about room * ln(room) items, and its table room times that. The subset is the same."""
    value = F.greatest(F.lit(0), F.rint(F.col("score") * VALUE_SCALE)).cast("long")
    best = Window.partitionBy("grp", "tokens").orderBy(F.desc("value"), "ord")
    fits = items.groupBy("grp").agg((F.sum("tokens") <= F.max("room")).alias("all_fit"))
    valued = items.select("grp", "ord", "ref", "tokens", "score", "room", value.alias("value"))
    few = valued.withColumn("at", F.row_number().over(best)).where(F.col("at") * F.col("tokens") <= F.col("room"))

    def fill(frame):
        if frame["all_fit"].iloc[0]:
            return frame
        frame = frame[frame["value"] > 0]
        return frame.iloc[best_subset(frame["tokens"].tolist(), frame["value"].tolist(), int(frame["room"].iloc[0]) if len(frame) else 0)]

    def run(frames):
        import pandas as pd

        held, names = [], ["grp", "ref", "tokens", "score"]
        for frame in frames:
            if not len(frame):
                continue
            # the last group may go on in the next batch
            if held and held[-1]["grp"].iloc[-1] != frame["grp"].iloc[0]:
                yield fill(pd.concat(held))[names]
                held = []
            starts = [0, *(frame["grp"].to_numpy()[1:] != frame["grp"].to_numpy()[:-1]).nonzero()[0] + 1]
            done = []
            for at, end in zip(starts, starts[1:]):
                done.append(fill(pd.concat([*held, frame.iloc[at:end]]) if held else frame.iloc[at:end]))
                held = []
            if done:
                yield pd.concat(done)[names]
            held.append(frame.iloc[starts[-1] :])
        if held:
            yield fill(pd.concat(held))[names]

    # groups follow each other in a task, as a call for each costs more than most of them do. The window keeps a group whole and in order whatever the join becomes as it runs; a repartition by grp is left out where the join
    # seems to deal by grp, and then the rows lie as the larger side does
    rows = few.join(fits, "grp").select(F.col("grp").cast("long").alias("grp"), "ord", "ref", "tokens", "score", "room", "value", "all_fit")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("ord")))
    return rows.select("grp", "ref", "tokens", "score", "room", "value", "all_fit", "place").mapInPandas(run, "grp long, ref long, tokens int, score double")


def project(scored: DataFrame, budget: int) -> DataFrame:
    """scored (grp, ord, ref, tokens, pinned, score, relevance) with selected and how: pin, reserve, knapsack or none."""
    used = scored.groupBy("grp").agg((F.lit(budget) - F.coalesce(F.sum(F.when(F.col("pinned"), F.col("tokens"))), F.lit(0))).cast("int").alias("room"))
    free = scored.where(~F.col("pinned")).join(used, "grp")
    kept = reserve(free)
    left = kept.groupBy("grp").agg(F.first("used").alias("reserved"))
    pool = free.join(kept.select("grp", "ref"), ["grp", "ref"], "left_anti").join(left, "grp", "left").withColumn("room", F.greatest(F.col("room") - F.coalesce("reserved", F.lit(0)), F.lit(0)).cast("int"))
    chosen = knapsack(pool).select("grp", "ref", F.lit("knapsack").alias("_how")).union(kept.select("grp", "ref", F.lit("reserve")))
    out = scored.join(chosen, ["grp", "ref"], "left").withColumn("how", F.when(F.col("pinned"), "pin").otherwise(F.coalesce("_how", F.lit("none"))))
    return out.drop("_how").withColumn("selected", F.col("how") != "none")


ship(__name__)
