"""Exact duplicates by skew-safe combining.

Texts are equal when identical without their ASCII white space; null counts as empty. Of equal
texts the row with the most code points in its original text stays, then the one with the smallest
doc_id (a null id counts as larger than any). Three rounds, and each compares whole contents,
because the content itself is part of the grouping key: copies inside a task are combined before
anything moves (Spark's partial aggregate), salted digest groups are merged next, and the salts'
winners last. So a text with any number of copies reaches the last round as SALTS rows at most.
Every row is returned, dropped ones too; rows that repeat whole, ids included, are all kept=True
when they equal the row that stays. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, stash, text_of

SALTS = 16


def normalised(c: Column) -> Column:
    return F.translate(c, WS, "")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, digest=None) -> DataFrame:
    """One row per different text: digest, content (null unless another text has the digest), keep_id, group_size."""
    digest = digest or (lambda c: F.unhex(F.sha2(c, 256)))
    body = text_of(text)
    rows = docs.select(
        normalised(body).alias("content"),
        F.struct(F.length(body).alias("n"), F.col(doc_id).isNotNull().alias("has"), F.bitwise_not(F.col(doc_id)).alias("neg")).alias("best"),
        F.lit(1).cast("long").alias("size"),
        (F.spark_partition_id() % salts).alias("salt"),
    ).withColumn("digest", digest(F.col("content")))
    merge = [F.max("best").alias("best"), F.sum("size").alias("size")]
    salted = rows.groupBy("digest", "salt", "content").agg(*merge)
    whole = salted.repartition("digest").groupBy("digest", "content").agg(*merge)
    told = whole.withColumn("texts", F.count("*").over(Window.partitionBy("digest")))
    return told.select(
        "digest",
        F.when(F.col("texts") > 1, F.col("content")).alias("content"),
        F.bitwise_not(F.col("best.neg")).alias("keep_id"),
        F.col("best.n").alias("keep_n"),
        F.col("size").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, digest=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    digest = digest or (lambda c: F.unhex(F.sha2(c, 256)))
    found = stash(classes(docs, text, doc_id, salts, digest), "exact-classes")
    body = text_of(text)
    content = normalised(body)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.length(body).alias("n"), content.alias("text"), digest(content).alias("digest"), F.sha2(content, 256).alias("text_sha256"))
    on = F.col("r.digest") == F.col("c.digest")
    if found.where(F.col("content").isNotNull()).isEmpty():
        joined = rows.drop("text").alias("r").join(found.alias("c"), on)
    else:  # different texts with one digest: the content decides
        joined = rows.alias("r").join(found.alias("c"), on & (F.col("c.content").isNull() | (F.col("c.content") == F.col("r.text"))))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("kept"),
        "text_sha256",
    )
