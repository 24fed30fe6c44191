"""A training-corpus pipeline: quality, shared lines, near duplicates, mixing, tokens. Each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name, stash, table, text_of
from palimpsest.llm.line_dedup import line_dedup
from palimpsest.llm.mixing import mix
from palimpsest.llm.ngram_join import classes, text_key
from palimpsest.llm.quality import score_quality
from palimpsest.llm.queries import MODEL
from palimpsest.llm.sentencepiece_codec import encode


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns that docs came with; n_chars follows the text."""
    return docs.select(*[F.length(text_of("text")).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in like.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as bad go. Null, empty and very long texts are scored like others, rows that repeat each; null ids are never labelled.
    An empty table stays empty; without labels of both kinds nothing goes. Columns of any name are kept."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(scored.columns[-1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all of them; each document stays, rows that repeat too, and n_chars follows the text. A null text becomes an empty one.
    An empty table stays empty. Columns of any name are kept."""
    return _columns(line_dedup(docs), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the smallest id, then of the smallest hash of its text; null ids come last. Of rows of one id and text any one stays.
    Texts without words, null ones too, all stay. Very long texts are compared whole. An empty table stays empty. Columns of any name are kept."""
    near_id, near_key, stays = (free_name(docs.columns, x) for x in ("near_id", "near_key", "stays"))
    rows = stash(classes(docs).where(F.col("component").isNotNull()).groupBy("component", "doc_id", "key").agg(F.count("*").alias("times")), "near-rows")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f"))
    told = rows.join(first, "component").withColumn("stays", (F.col("key") == F.col("f.key")) & F.col("doc_id").eqNullSafe(F.col("f.doc_id")))
    told = stash(told.where(~F.col("stays") | (F.col("times") > 1)).select(F.col("doc_id").alias(near_id), F.col("key").alias(near_key), F.col("stays").alias(stays)), "near-told")
    at = text_key("text").eqNullSafe(F.col(near_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(near_id))
    own = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(told, at, "left_anti")
    again = told.where(F.col(stays))
    if again.isEmpty():
        return kept.select(*own)
    # rows of one id and text: any one of them
    once = docs.join(again, at).dropDuplicates([near_id, near_key])
    return kept.select(*own).union(once.select(*own))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Texts without words, null ones too, go, as they have no words to give; rows that repeat are taken alike.
    A null source is a source. An empty table stays empty. Columns of any name are kept."""
    mixed = mix(docs)
    copies = mixed.columns[len(docs.columns) + 3]
    taken = mixed.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their number, and whether they decode to its text. A null text has no ids. An empty table gives an empty result. Further columns are left behind."""
    out = encode(docs.select("doc_id", "source", "lang", "text"), MODEL)
    return out.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == text_of("text")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing", mixing_stage),
    ("SentencePiece", token_stage),
]

#: The ranking's fit, the random mix and the tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
