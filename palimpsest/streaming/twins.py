"""Streaming twins of the batch operators: versions that close as their successors come, windowed counts, sessions, and late data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import ship

VERSION = "fact_key long, version int, event_id long, content string, recorded_at timestamp, superseded_at timestamp, superseded_by long"
STATE = "version int, event_id long, content string, recorded_at timestamp"


def closed_versions(events: DataFrame) -> DataFrame:
    """A stream of events (fact_key, event_id, content, recorded_at) as versions, each written once its successor has come; the state is a fact's last version, one row a fact.

    An event that comes after one recorded later than it would end a version before it began: it is passed over, and a rebuild from the log gives it its place."""

    def step(key, frames: Iterator, state):
        import pandas as pd

        new = pd.concat(list(frames)).sort_values(["recorded_at", "event_id"])
        held, out = (state.get if state.exists else None), []
        for x in new.itertuples(index=False):
            if held is not None and (x.recorded_at, x.event_id) < (held[3], held[1]):
                continue
            if held is not None:
                out.append((key[0], held[0], held[1], held[2], held[3], x.recorded_at, x.event_id))
            held = ((held[0] if held is not None else 0) + 1, x.event_id, x.content, x.recorded_at)
        state.update(held)
        yield pd.DataFrame(out, columns=["fact_key", "version", "event_id", "content", "recorded_at", "superseded_at", "superseded_by"])

    return events.groupBy("fact_key").applyInPandasWithState(step, VERSION, STATE, "append", "NoTimeout")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once, within the watermark."""
    return events.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per kind and tumbling window; a window is written when the watermark has passed it."""
    counts = events.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", size).alias("w"), "kind").agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("from"), "kind", "events")


def sessionized(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Runs of a fact's events with gaps below the given one."""
    s = events.withWatermark("recorded_at", late).groupBy(F.session_window("recorded_at", gap).alias("w"), "fact_key").agg(F.count("*").alias("events"))
    return s.select("fact_key", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "events")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and read its result; folder is a shared one."""
    spark, at = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The driver's events as a stream, time as an instant for the watermark."""
    table = spark.read.parquet(path)
    one = table.select("_metadata.file_name").first()
    folder, _, name = path.rpartition("/")
    # a stream reads folders: a table that is a single file is picked out of the folder it lies in
    place, kind = (folder, name) if one and one[0] == name else (path, "*.parquet")
    raw = spark.readStream.schema(table.schema).option("pathGlobFilter", kind).parquet(place)
    return raw.select(F.col("user_id").alias("fact_key"), "event_id", F.col("event_type").alias("kind"), F.concat_ws(":", "event_type", "props").alias("content"), F.col("ts").cast("timestamp").alias("recorded_at"))


ship(__name__)
