"""What the corpus operators share: white space, ASCII case, row keys and tables in the shared folder."""

from __future__ import annotations

import math
import sys
import tempfile
import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters and the two letter cases.
WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send this module's functions to Python workers by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; text that is all ASCII takes the cheap built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WS))


def hash128(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds; fixed-width, so aggregates on them stay in the hash map."""
    return F.xxhash64(c), F.xxhash64(F.lit(7), c)


def free_name(taken: Sequence[str], name: str) -> str:
    """name, or name with underscores in front, such that no column of the input is hidden by it."""
    seen = {x.lower() for x in taken}
    while name.lower() in seen:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a new temporary one if all runs on this machine, as in tests, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stash(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing.

    batch_rows bounds the rows that go to a Python worker at once while this is written; rows may be long.
    """
    return put(df, label, batch_rows)[0]


def put(df: DataFrame, label: str, batch_rows: int | None = None) -> tuple[DataFrame, str]:
    """As stash, with the folder, for tables that are erased when the next one is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    if batch_rows:
        spark.conf.set(ARROW_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path), path


def integers(vector: Column, scale: int, dim: int) -> Column:
    """floor(scale * x) of each component, in double precision; what lies beyond limit(dim) counts as that."""
    most = F.lit(limit(dim)).cast("long")
    return F.transform(vector, lambda e: F.greatest(-most, F.least(most, F.floor(e.cast("double") * scale).cast("long"))))


def limit(dim: int) -> int:
    """The largest size of a component such that squared distances and products of vectors so long fit 64 bits."""
    return math.isqrt((1 << 60) // max(dim, 1))


def finite(vector: Column) -> Column:
    """True where the vector is there and each component is a finite number."""
    return F.coalesce(F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))


def erase(path: str, spark: SparkSession) -> None:
    """Delete a folder that put() or an operator wrote and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
