"""Tables in the folder that all executors share, where a plan uses one result more than once."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one that the context was given. Where there is none a new temporary one if all runs on this machine, as in tests,
    else an error."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    if held.isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write df once and read it back, so that later uses scan columns instead of computing it again. batch_rows bounds the rows that go to a Python worker at once meanwhile; rows may be long."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    if batch_rows:
        spark.conf.set(ARROW_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def ship(module: str) -> None:
    """Send this module's functions to Python workers by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
