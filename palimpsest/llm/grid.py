"""A few against all: rows in stored shards, queries in blocks, and a task for each block and strip of shards.

A shard is a file of arrays over at most SHARD_BYTES of vectors, made where its rows are read, without a shuffle. A task holds one block of queries and streams its strip's shards, one at a
time, so it keeps k rows a query whatever the table's size. There are as many strips as it takes to have `tasks` of blocks and strips, and no more than shards: tasks grow with the blocks alone, and the rows that
they return, k a query and strip, never with shards times blocks.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put, shared_dir, ship

SHARD_BYTES, BLOCK = 8 << 20, 1024


def matrix(column, dim: int, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(dtype)


def write_shards(rows: DataFrame, dim: int, make: Callable, label: str, most: int | None = None) -> tuple[DataFrame, str]:
    """Store rows (any columns) in shards of make(table)'s arrays, of `most` rows at most. A table of path, rows and its folder; an attempt's file has a name of its own, and the table names those of committed attempts."""
    folder, most = f"{shared_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}", most or max(1, SHARD_BYTES // (8 * max(dim, 1)))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)

        def flush(part):
            system.create_dir(root, recursive=True)
            name, raw = uuid.uuid4().hex, io.BytesIO()
            np.savez(raw, **make(part))
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(raw.getbuffer())
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "rows": pa.array([len(part)], pa.int64())})

        held: list = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                room = most - sum(b.num_rows for b in held)
                held.append(batch.slice(at, room))
                at += held[-1].num_rows
                if held[-1].num_rows == room:
                    yield flush(pa.Table.from_batches(held).combine_chunks())
                    held = []
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return put(rows.mapInArrow(write, "path string, rows long"), f"{label}-shards")


def load(path: str) -> dict[str, np.ndarray]:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as f:
        found = np.load(io.BytesIO(f.read()))
        return {name: found[name] for name in found.files}


def strip_of(folder: str, strip: int, strips: int) -> Iterator[dict[str, np.ndarray]]:
    """The shards of a strip, one at a time; each task reads the table that names them, a row a shard."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(folder)
    files = [x.path for x in system.get_file_info(fs.FileSelector(place)) if x.path.endswith(".parquet")]
    paths = sorted(p for x in files for p in pq.read_table(x, columns=["path"], filesystem=system)["path"].to_pylist())
    for path in paths[strip::strips]:
        yield load(path)


def against(queries: DataFrame, key: str, n_queries: int, shards: DataFrame, folder: str, run: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """run(table of a block's queries, shards of a strip as an iterator of arrays) -> Arrow table, for each block of the queries and strip. key: a column that deals queries evenly to blocks."""
    spark, n_shards = queries.sparkSession, shards.count()
    blocks = max(1, -(-n_queries // block))
    strips = max(1, min(n_shards, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)))

    def task(group, part):
        return run(part.drop_columns(["_block", "_strip"]), strip_of(folder, group[1].as_py(), strips))

    dealt = queries.withColumns({"_block": F.pmod(F.xxhash64(F.lit(29), key), F.lit(blocks)), "_strip": F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))})
    # as many partitions as groups: a task of its own for most of them, none of them merged
    return dealt.repartition(blocks * strips, "_block", "_strip").groupBy("_block", "_strip").applyInArrow(task, schema)


ship(__name__)
