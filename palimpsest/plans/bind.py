"""How the driver's tables stand for the domain's: events are a version log, conversations and orders are session stores, documents are entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where they come in fewer pieces, as a file of one row group does; larger tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def version_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact per user; every fifth event is backdated to its day's start, every eleventh ends a day later."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("fact_key"),
        "event_id",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("update").alias("op"),
        F.when(F.col("user_id") % 2 == 0, "MEMORY.md").otherwise("USER.md").alias("store"),
        F.concat_ws(":", "event_type", "props").alias("content"),
        F.col("ts").alias("recorded_at"),
        F.when(F.col("event_id") % 5 == 0, F.date_trunc("day", "ts").cast("timestamp_ntz")).alias("valid_from"),
        F.when(F.col("event_id") % 11 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("valid_to"),
        "event_type",
        "value",
    )


#: The same as a DuckDB common table expression.
VERSION_EVENTS_SQL = """ev AS (
  SELECT user_id AS fact_key, event_id, event_id AS seq,
    CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'create' ELSE 'update' END AS op,
    CASE WHEN user_id % 2 = 0 THEN 'MEMORY.md' ELSE 'USER.md' END AS store,
    concat_ws(':', event_type, props) AS content, ts AS recorded_at,
    CASE WHEN event_id % 5 = 0 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS valid_from,
    CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 1 DAY END AS valid_to, event_type, value
  FROM events)"""

VERSIONS_SQL = VERSION_EVENTS_SQL + """, v0 AS (
  SELECT *, coalesce(valid_from, recorded_at) AS eff_valid_from,
    row_number() OVER w AS version, lead(recorded_at) OVER w AS superseded_at, lag(event_id) OVER w AS supersedes,
    lead(event_id) OVER w AS superseded_by, lead(coalesce(valid_from, recorded_at)) OVER w AS next_from
  FROM ev WINDOW w AS (PARTITION BY fact_key ORDER BY recorded_at, seq, event_id)
), v AS (
  SELECT fact_key, event_id, seq, op, store, content, recorded_at, valid_from, event_type, value, eff_valid_from, version, superseded_at, supersedes, superseded_by,
    CASE WHEN superseded_by IS NULL THEN valid_to ELSE greatest(next_from, eff_valid_from) END AS valid_to,
    CAST(op = 'delete' AS INTEGER) AS tombstone,
    CAST(superseded_by IS NULL AND op <> 'delete' AND valid_to IS NULL AS INTEGER) AS is_current
  FROM v0)"""


#: What entries carry besides a document's words, by doc_id: one of each signal.
TAILS = (
    "",
    " Prefers dark mode always.",
    " Fixed on 2024-03-05 and shipped 12/14 checks today.",
    " See ~/notes/plan.md for full context.",
    " TODO follow up on the setup",
    " Root cause: traceback in the parser.",
    " Phase 2 milestone in progress 45% on 2024-02-30.",
    " postgres is the default store, enabled and running.",
    " sqlite is the default store, disabled and stopped.",
    " Switched to v2.3.1 on 2023-11-20 at /srv/data/app/config.yaml",
    " various stuff needs work",
    " Never share the api key. Do not deploy without approval.",
    " → archived 2024-02-01. Find: notes",
    " everything is listed.",
    " api_key: sk-abcdefghijklmnop1234 and 9f86d081884c7d659a2feaa0c55ad015",
    " [M12] dream reflection",
)
HEADS = {12: "↪ ", 13: "Long-form notes live in ~/notes: ", 3: "Model routing: ", 1: "User: "}
TODAY = "2024-06-01"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot-memory entries of mixed length: whole documents between a head and a tail."""
    k = (F.col("doc_id") % len(TAILS)).cast("int")
    head = F.coalesce(*[F.when(k == i, h) for i, h in HEADS.items()], F.lit(""))
    text = F.concat(head, "text", F.get(F.array(*[F.lit(t) for t in TAILS]), k))
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("ref"), F.when(F.col("doc_id") % 2 == 0, "memory").otherwise("user").alias("store"), text.alias("text"))


def altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries again as they might have been: a third as they are, a third with more at the end, a third with another beginning."""
    k = F.col("ref") % 3
    return entries(spark, sf_dir).withColumn("text", F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit(" Changed since."))).otherwise(F.concat(F.lit("Formerly "), "text")))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ENTRIES_SQL = (
    "e AS (SELECT doc_id AS ref, CASE WHEN doc_id % 2 = 0 THEN 'memory' ELSE 'user' END AS store, CASE doc_id % 16 "
    + " ".join(f"WHEN {i} THEN {quoted(h)}" for i, h in HEADS.items())
    + " ELSE '' END || text || ["
    + ", ".join(map(quoted, TAILS))
    + "][doc_id % 16 + 1] AS text FROM documents)"
)
ALTERED_SQL = "e2 AS (SELECT ref, store, CASE ref % 3 WHEN 0 THEN text WHEN 1 THEN text || ' Changed since.' ELSE 'Formerly ' || text END AS text FROM e)"
