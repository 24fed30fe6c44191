"""Joins on token sets: by Jaccard in tasks that keep their candidates (setjoin), else by an equi-join on tokens, so that no pair without a common token is looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from . import setjoin as J


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """sets (id, tokens without repeats) -> a < b, common, either, na, nb, for pairs with common / either >= threshold. Empty sets pair with nothing. Equal sets are compared once."""
    members, pairs = _classes(sets, threshold)
    x, y = members.alias("x"), members.alias("y")
    alike = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), *[F.col("x.n").alias(c) for c in ("common", "na", "nb")])
    first, lone = F.col("p.id") < F.col("q.id"), members.where("id <> rep").isEmpty()
    if not lone:
        both = pairs.join(members.alias("p"), F.col("a") == F.col("p.rep")).join(members.alias("q"), F.col("b") == F.col("q.rep"))
        pick = lambda one, two: F.when(first, F.col(one)).otherwise(F.col(two))
        pairs = both.select(pick("p.id", "q.id").alias("a"), pick("q.id", "p.id").alias("b"), "common", pick("p.n", "q.n").alias("na"), pick("q.n", "p.n").alias("nb")).unionByName(alike)
    return _sized(pairs)


def similar_between(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """left and right sets (id, tokens without repeats) -> a of the left, b of the right, common, either, na, nb, for pairs with common / either >= threshold. Equal sets of a side are compared once."""
    words = J.Words(left, right)
    sides = [words.encoded(s) for s in (left, right)]
    members = [J.classes(e) for e in sides]
    pairs = J.met(*[J.shards(J.firsts(e, m)) for e, m in zip(sides, members, strict=True)], threshold, left.sparkSession)
    of = lambda m, name, rep: m.select(F.col("id").alias(name), F.col("rep").alias(rep))
    told = pairs.withColumnsRenamed({"a": "ra", "b": "rb"}).join(of(members[0], "a", "ra"), "ra").join(of(members[1], "b", "rb"), "rb")
    return _sized(told.select("a", "b", "common", "na", "nb"))


def _sized(pairs: DataFrame) -> DataFrame:
    n = {c: F.col(c).cast("int") for c in ("common", "na", "nb")}
    return pairs.select("a", "b", n["common"].alias("common"), (n["na"] + n["nb"] - n["common"]).alias("either"), n["na"].alias("na"), n["nb"].alias("nb"))


def _classes(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    encoded = J.Words(sets).encoded(sets)
    members = J.classes(encoded)
    return members, J.met(J.shards(J.firsts(encoded, members)), None, threshold, sets.sparkSession)


def similar_classes(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep, the smallest id among those with the same tokens; pairs of different bags' reps as from similar_pairs). k copies of a text are k rows and one side of each pair, however many they are."""
    members, pairs = _classes(sets, threshold)
    return members.select("id", "rep"), _sized(pairs)


def nearest(left: DataFrame, right: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Each left set's best right set by Jaccard, ties to the smaller id; left sets without a common token, or below the threshold, are left out.

    With a threshold only similar sets are joined. Without one every common token can decide, and all are."""
    if threshold > 0:
        one, two = _numbered(left), _numbered(right)
        pairs = similar_between(*[x.select(F.col("_k").alias("id"), "tokens") for x in (one, two)], threshold)
        named = pairs.join(one.select(F.col("_k").alias("a"), "id"), "a").join(two.select(F.col("_k").alias("b"), F.col("id").alias("other")), "b")
        met = named.select("id", "other", F.col("na").alias("n"), F.col("nb").alias("m"), F.col("common").cast("long").alias("common"))
    else:
        l = left.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        r = right.select(F.col("id").alias("other"), F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
        met = l.join(r, "token").groupBy("id", "other", "n", "m").agg(F.count("*").alias("common"))
    scored = met.withColumn("score", F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).where(F.col("score") >= threshold)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", F.col("other").alias("best_id"), "common", (F.col("n") + F.col("m") - F.col("common")).alias("either"), "score")


def _numbered(sets: DataFrame) -> DataFrame:
    """sets with _k, a number that stands for the id in a join: an id of whole numbers itself, else its hash, or a new number where two hashes meet."""
    if sets.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return sets.withColumn("_k", F.col("id").cast("long"))
    hashed = sets.withColumn("_k", F.xxhash64("id"))
    if hashed.groupBy("_k").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").isEmpty():
        return hashed
    return stored(sets.withColumn("_k", F.monotonically_increasing_id()), "numbered-sets")


def repeats(left: DataFrame, right: DataFrame, jaccard: float, share: float) -> DataFrame:
    """id of the left sets that are near a right set by Jaccard, or of whose tokens one right set holds at least share.

    Either needs the lesser part of the left tokens in common, so only a prefix of the left set, rarest first, is looked up (setjoin), and no pair leaves a task."""
    # rows are numbered, as ids may repeat; tokens are made once
    rows = [stored(s.select("id", "tokens").withColumn("_k", F.monotonically_increasing_id()), "repeat-sets") for s in (left, right)]
    sets = [r.select(F.col("_k").alias("id"), "tokens") for r in rows]
    words = J.Words(*sets)
    encoded = [words.encoded(s) for s in sets]
    members = [J.classes(e) for e in encoded]
    shards = [J.shards(J.firsts(e, m)) for e, m in zip(encoded, members, strict=True)]
    found = J.repeated(*shards, jaccard, share, left.sparkSession).withColumnRenamed("id", "rep")
    mine = members[0].select(F.col("id").alias("_k"), "rep").join(found, "rep")
    return rows[0].select("_k", "id").join(mine, "_k").select("id").distinct()


def containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left set's best share of tokens held by one right set."""
    l = left.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    r = right.select(F.col("id").alias("other"), F.explode("tokens").alias("token"))
    met = l.join(r, "token").groupBy("id", "other", "n").agg(F.count("*").alias("common"))
    w = Window.partitionBy("id").orderBy(F.desc("common"), "other")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", F.col("other").alias("best_id"), "common", "n")
