"""Readers and writers of the domain's files, all through Spark's own sources, so any file system Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DELIMITER
from ..functions.shared import ship
from ..functions.text import content_hash, strip
from ..operators.temporal import has_delimiter, prune
from .versioned import read_table, write_table

EVENT = "event_id STRING, fact_key STRING, store STRING, seq BIGINT, op STRING, title STRING, content STRING, content_hash STRING, taxonomy STRING, valid_from STRING, valid_to STRING, recorded_at STRING, source STRING, confidence DOUBLE, actor STRING, reason STRING, tags ARRAY<STRING>, archived_path STRING"
SHADOW = "tool STRING, mode STRING, turn_id STRING, generated_at STRING, projected STRUCT<tokens: INT, savings_pct: DOUBLE, retrieval_telemetry: STRUCT<path: STRING, retrieval_latency_ms: DOUBLE>>, answer_usage STRUCT<used_selected_count: INT, used_missing_from_projection: ARRAY<STRUCT<entry_ref: STRING, reason: STRING>>>"


def _whole(spark: SparkSession, path) -> DataFrame:
    """path, value: whole files as text; bytes that aren't UTF-8 become U+FFFD."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _lines(spark: SparkSession, path) -> DataFrame:
    """path, at (the line's number in its file, from 0), line: files cut at line feeds only, each in as many tasks as it has splits.

    A task numbers its lines; what the splits before it hold comes from counts of splits, which are few."""
    # a line feed that another character stands before doesn't count as a line's end elsewhere: U+2028 and its like stay in the line
    raw = spark.read.option("lineSep", "\n").text(path)
    read = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = read.groupBy("path", "block").agg(F.min("n").alias("first"), F.count("*").alias("k"))
    before = splits.select("path", "block", "first", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"))
    return read.join(before, ["path", "block"]).select("path", (F.col("n") - F.col("first") + F.col("before")).alias("at"), "line")


def read_entries(spark: SparkSession, path, store: str) -> DataFrame:
    """store, raw_index, index, ref, text of a delimited file; blank entries are dropped, index counts the rest."""
    cut = _whole(spark, path).select("path", F.posexplode(F.split("value", DELIMITER)).alias("raw_index", "raw")).withColumn("text", strip(F.col("raw"))).where("text <> ''")
    w = Window.partitionBy("path").orderBy("raw_index")
    return cut.select(F.lit(store).alias("store"), "raw_index", (F.row_number().over(w) - 1).alias("index"), "text").withColumn("ref", F.concat_ws("#", "store", "index"))


def read_event_log(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of a JSON-lines log cut at line feeds only. Bad: not an object, or without fact_key or content. Missing seq is the line's number, missing recorded_at
    is valid_from, else the time of reading."""
    lines = _lines(spark, path).where(F.trim("line") != "")
    read = lines.withColumn("e", F.from_json("line", EVENT, {"mode": "PERMISSIVE"}))
    good = F.col("e").isNotNull() & F.col("e.fact_key").isNotNull() & F.col("e.content").isNotNull()
    events = read.where(good).select("at", "e.*")
    events = events.withColumn("seq", F.coalesce("seq", F.col("at") + 1)).withColumn("event_id", F.coalesce("event_id", F.concat(F.lit("line-"), F.col("seq").cast("string"))))
    events = events.withColumn("recorded_at", F.coalesce("recorded_at", "valid_from", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))).drop("at")
    return events, read.where(~F.coalesce(good, F.lit(False))).select("path", F.col("at"), "line")


def quarantine(bad: DataFrame, path: str, seen: DataFrame | None = None) -> None:
    """Append bad lines that aren't in the quarantine yet."""
    new = bad.select("line") if seen is None else bad.select("line").join(seen.select("line"), "line", "left_anti")
    new.select(F.col("line").alias("value")).write.mode("append").text(path)


def read_shadow_events(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events, errors with path and line number) of telemetry logs."""
    lines = _lines(spark, paths).where(F.trim("line") != "")
    read = lines.withColumn("e", F.from_json("line", SHADOW))
    bad = ~F.startswith(F.ltrim("line"), F.lit("{")) | F.col("e").isNull() | F.expr("try_parse_json(line) IS NULL")
    return read.where(~bad).select("path", F.col("at").alias("ordinal"), "e.*"), read.where(bad).select("path", (F.col("at") + 1).alias("line_number"), "line")


def read_fixtures(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines with # comments; bad JSON is an error."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_tasks(spark: SparkSession, path) -> DataFrame:
    return spark.read.json(path, multiLine=True).select(F.explode("tasks").alias("t")).select("t.*")


def archive_blocks(c: Column) -> Column:
    """Blocks that begin with a heading and a status line, as structs of their fields."""
    blocks = F.filter(F.split(c, r"(?m)(?=^## .+\nStatus:)"), lambda b: F.startswith(b, F.lit("## ")))
    of = lambda b, p: F.trim(F.regexp_extract(b, p, 1))
    return F.transform(
        blocks,
        lambda b: F.struct(
            of(b, r"^## (.+)").alias("slug"), of(b, r"(?m)^Status: *(.*)$").alias("status"), of(b, r"(?m)^Archived: *([^|\n]*)").alias("archived"), of(b, r"Source: *([^|\n]*)").alias("source"), of(b, r"Taxonomy: *([^|\n]*)").alias("taxonomy"),
            of(b, r"Hash: *([^|\n]*)").alias("hash"), of(b, r"(?m)^Verdict: *([^|\n]*)").alias("verdict"), of(b, r"Reason: *([^|\n]*)").alias("reason"), of(b, r"(?m)^Backlink: *(.*)$").alias("backlink"), strip(F.regexp_extract(b, r"(?s)\n\n(.*)\z", 1)).alias("body"),
        ),
    )


def read_archive(spark: SparkSession, path) -> DataFrame:
    return _whole(spark, path).select("path", F.explode(archive_blocks(F.col("value"))).alias("b")).select("path", "b.*")


def read_notes_index(spark: SparkSession, path) -> DataFrame:
    """path and description of bullet lines that name a Markdown file."""
    bullet = r"^\s*[-*]\s+`?([^\s`]+\.md)`?\s*(?:[—–:-]+\s*(.*))?$"
    return spark.read.text(path).where(F.col("value").rlike(bullet)).select(F.regexp_extract("value", bullet, 1).alias("path"), F.regexp_extract("value", bullet, 2).alias("description"))


def read_transcripts(spark: SparkSession, path, turns: int = 20) -> DataFrame:
    """Human turns of JSON-lines transcripts: text of string or list contents, one per first 80 characters, the first `turns` of a session (the format's sampling rule)."""
    kind = "type STRING, message STRUCT<role: STRING, content: STRING>"
    lines = _lines(spark, path).withColumnRenamed("at", "ord").withColumn("e", F.from_json("line", kind)).where("e.message.role = 'user'")
    raw = F.col("e.message.content")
    parts = F.array_join(F.transform(F.filter(F.from_json(raw, "ARRAY<STRUCT<type: STRING, text: STRING>>"), lambda x: x["type"] == "text"), lambda x: x["text"]), " ")
    said = lines.withColumn("content", strip(F.when(F.startswith(raw, F.lit("[")), F.coalesce(parts, raw)).otherwise(raw))).where("content <> ''").withColumn("key", F.left("content", F.lit(80)))
    once = said.withColumn("n", F.row_number().over(Window.partitionBy("path", "key").orderBy("ord"))).where("n = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("ord"))).where(F.col("n") <= turns).select("path", "ord", "content")


def newest_file(spark: SparkSession, path) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    return files.agg(F.max_by("path", "modificationTime").alias("path"), F.max("modificationTime").alias("modified"))


def read_crons(spark: SparkSession, path, words=("memory", "temporal", "semantic")) -> DataFrame:
    """Registered jobs whose name holds one of the words, with error and paused flags."""
    jobs = spark.read.schema("name STRING, last_status STRING, state STRING, paused_at STRING").json(path, multiLine=True)
    return jobs.where(F.lower("name").rlike("|".join(words))).withColumn("failed", F.col("last_status") == "error").withColumn("paused", (F.col("state") == "paused") | F.col("paused_at").isNotNull())


def role_of(path: Column) -> Column:
    """What a store's place says of it: a profile's, a backup, a work copy, else the main one."""
    parts = F.split(path, "/")
    return F.when(F.exists(parts, lambda p: p.isin("backup", "backups", "_archive")), "backup").when(F.array_contains(parts, "profiles"), "profile").when(F.exists(parts, lambda p: p.isin("work", "tmp")), "work").otherwise("main")


#: Fixed value: how a SQLite file begins.
SQLITE_MAGIC = b"SQLite format 3\x00"


def _begins(paths):
    """Whether each file begins as a SQLite file; null where it can't be read."""
    import pyarrow as pa
    from pyarrow import fs

    out = []
    for p in paths.to_pylist():
        try:
            system, place = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
            with system.open_input_file(place) as f:
                out.append(f.read(len(SQLITE_MAGIC)) == SQLITE_MAGIC)
        except OSError:
            out.append(None)
    return pa.array(out, pa.bool_())


def discover_stores(spark: SparkSession, root: str, names: str = "*.db") -> DataFrame:
    """path, role, bytes, modified, is_sqlite of every store under a folder, however deep, of which only the first bytes are read. Links to folders are followed as Spark's listing does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    listed = files.select("path", role_of(F.col("path")).alias("role"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return listed.withColumn("is_sqlite", F.arrow_udf(_begins, "boolean")("path"))


def append_events(events: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> None:
    """Append to the event log, a versioned table, in one commit; a batch of a named writer once, however often it is tried."""
    write_table(events, path, "append", writer=writer, batch=batch)


def append_stream(events: DataFrame, path: str, name: str, checkpoint: str):
    """The started query that appends a stream's batches to the event log, each once."""
    return events.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, k: append_events(batch, path, name, k)).start()


def write_json(rows: DataFrame, path: str) -> None:
    """A report, candidate list or manifest as JSON lines, a version a run; a failed job leaves the last one readable."""
    write_table(rows, path, "overwrite", "json")


ARCHIVE = "slug string, body string, sha256 string"


def archive_first(archives: DataFrame, folder: str, manifest_path: str) -> DataFrame:
    """Append bodies (slug, body) to the archive, a versioned table, before anything else changes, then a manifest of what was written, read back and hashed: slug, sha256, matches.

    What the caller removes afterwards it removes by this manifest, so nothing goes that isn't in the archive. Earlier runs' archives stay; a body that is there under its slug isn't
    written again, and a slug with another body, there or in this run, is refused before anything is written. Null bodies are empty; null slugs are refused."""
    spark = archives.sparkSession
    rows = archives.select("slug", F.coalesce("body", F.lit("")).alias("body")).withColumn("sha256", F.sha2("body", 256))
    asked = rows.groupBy("slug", "sha256").agg(F.any_value("body").alias("body"))
    held = read_table(spark, folder, schema=ARCHIVE).select("slug", F.sha2("body", 256).alias("sha256"))
    both = asked.select("slug", "sha256").unionByName(held).groupBy("slug").agg(F.count_distinct("sha256").alias("bodies"))
    bad = both.where("bodies > 1").join(asked.select("slug").distinct(), "slug", "left_semi").unionByName(asked.where("slug is null").select("slug", F.lit(0).alias("bodies"))).limit(5).collect()
    if bad:
        raise ValueError(f"slugs that name several bodies, or none: {[r.slug for r in bad]}")
    write_table(asked.join(held, ["slug", "sha256"], "left_anti").select("slug", "body", "sha256"), folder)
    read = read_table(spark, folder).select("slug", F.sha2("body", 256).alias("sha256")).distinct().withColumn("_there", F.lit(True))
    result = asked.select("slug", "sha256").join(read, ["slug", "sha256"], "left").select("slug", "sha256", F.coalesce("_there", F.lit(False)).alias("matches"))
    write_table(result, manifest_path, "overwrite")
    return read_table(spark, manifest_path)


def append_hot(entries: DataFrame, path: str, actor: str) -> DataFrame:
    """Append entries (store, text) to the hot table with their provenance in the same rows and the same commit, so neither is there without the other; returns those refused, which hold a
    delimiter or are blank."""
    bad = has_delimiter(F.col("text")) | (strip(F.coalesce("text", F.lit(""))) == "")
    write_table(entries.where(~bad).select("store", "text", content_hash(F.col("text")).alias("hash"), F.lit(actor).alias("actor"), F.current_timestamp().alias("at")), path)
    return entries.where(bad)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Who appended which entry to a hot table, and when."""
    return read_table(spark, path).select("store", "hash", "actor", "at")


def split_cold(v: DataFrame, cutoff: Column, keep: int, hot_path: str, cold_path: str) -> tuple[DataFrame, DataFrame]:
    """Move the versions that prune() marks as cold to the cold table, and leave the others as the hot table; both as read back.

    Cold is committed and read back first, and only if it holds every cold version is hot overwritten, so a version is always in one of them. A run that was broken off is made good by the next: what is cold already isn't
    written again."""
    spark, key = v.sparkSession, ["fact_key", "version", "event_id"]
    marked = prune(v, cutoff, keep)
    cold = marked.where("not hot").drop("hot")
    held = read_table(spark, cold_path, schema=cold.schema).select(*key)
    write_table(cold.join(held, key, "left_anti").select(*cold.columns), cold_path)
    there = read_table(spark, cold_path)
    if not cold.join(there, key, "left_anti").isEmpty():
        raise ValueError("cold versions are missing from the cold table; hot is left as it was")
    write_table(marked.where("hot").drop("hot"), hot_path, "overwrite")
    return read_table(spark, hot_path), there


def concatenated(*stores: DataFrame) -> DataFrame:
    """Entries of several stores one after the other: store_at and index keep the files' order."""
    out = None
    for k, s in enumerate(stores):
        part = s.withColumn("store_at", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def upsert_vectors(existing: DataFrame, incoming: DataFrame, drop_others: bool = True) -> DataFrame:
    """The collection after an upsert: a vector that comes again takes the place of the one that is there. Ids that don't come are no longer wanted and go, unless others may stay."""
    return incoming if drop_others else existing.join(incoming.select("id"), "id", "left_anti").unionByName(incoming, allowMissingColumns=True)


ship(__name__)
