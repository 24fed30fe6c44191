"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records up to FRAME bytes, and a seek table in
a skippable frame at its end (per frame: compressed and plain size), as the public seekable format has it. An
index maps each record id to its bundle, frame, offset in the frame and length, so one record costs one read of the
seek table, one read of a frame and its decompression.

Of records with equal payloads of at least MIN_SAME bytes the one with the smallest id is a response and the
others revisit it, without their payload; smaller payloads are always responses. Null html is an empty payload.
Rows that repeat the smallest id are responses each; a null id counts as larger than any. A payload of any length is one record.
Extra columns are left alone, whatever their names. An empty table gives no bundle and an empty index.

Each attempt of a task writes a bundle of its own name, and the index names the bundle of the attempt that was committed, so a task that runs twice,
in whatever order its rows come, leaves the index and its bundle in agreement; a bundle that no index names may be deleted.
Memory is one frame and one Arrow batch, of BATCH rows or Spark's limit of bytes at most. The folder is any place pyarrow's file systems reach.

What is read back is measured anew: length and digest come from the payload out of the frame, those of a revisit from the record it refers to.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, ship, stash, text_of

FRAME, MIN_SAME, LEVEL, BATCH = 1 << 20, 100, 3, 64
#: Fixed values of the public formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id long, bundle string, frame int, start long, length long, record_type string, payload_digest string"


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_same: int = MIN_SAME) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to. A payload's copies meet as one row per task, not as rows."""
    body = F.encode(text_of(html), "utf-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.length("payload") >= min_same).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    many = first.where("copies > 1").select(F.col("digest").alias("d"), "first_id")
    joined = rows.join(many, F.col("digest") == F.col("d"), "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def warc_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """A response holds an HTTP head and the payload; a revisit holds the head alone and names the record that has its payload."""
    block = HTTP + payload if kind == "response" else HTTP
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload, without the HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """Per frame: place in the file, compressed size, plain size."""
    end = file.size()
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(end - 9 - width * count)
    raw, at, out = file.read(width * count), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, width * i)
        out.append((at, packed, plain))
        at += packed
    return out


def open_bundle(bundle: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(bundle)
    return system.open_input_file(path)


def read_frame(file, table, k: int) -> bytes:
    import zstandard

    at, packed, plain = table[k]
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=max(plain, 1))


def fetch(bundle: str, frame: int, start: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index row."""
    with open_bundle(bundle) as file:
        return parse_record(read_frame(file, read_seek_table(file), frame)[start : start + length])


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME) -> DataFrame:
    """Write records (of plan_records) and return the index, itself written to the shared folder."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.zst"
        pack, file, sizes, rows, frame, plain, temp = zstandard.ZstdCompressor(level=LEVEL), None, [], [], [], 0, f"{root}/.{name}"

        def flush():
            nonlocal frame, plain
            raw = b"".join(frame)
            data = pack.compress(raw)
            file.write(data)
            sizes.append((len(data), len(raw)))
            frame, plain = [], 0

        def told():
            out = pa.RecordBatch.from_pylist(rows, schema=schema)
            rows.clear()
            return out

        schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")}
                raw = warc_record(x["page_id"], x["url"], x["payload"], x["digest"], x["record_type"], x["refers_to"])
                if file is None:
                    system.create_dir(root, recursive=True)
                    file = system.open_output_stream(temp, compression=None)
                if frame and plain + len(raw) > frame_bytes:
                    flush()
                rows.append({"page_id": x["page_id"], "bundle": f"{folder}/{name}", "frame": len(sizes), "start": plain, "length": len(raw), "record_type": x["record_type"], "payload_digest": x["digest"]})
                frame.append(raw)
                plain += len(raw)
            if rows:
                yield told()
        if file is not None:
            flush()
            file.write(seek_table(sizes))
            file.close()
            system.move(temp, f"{root}/{name}")

    return stash(records.mapInArrow(write, INDEX), "warc-index", BATCH)


READ = "page_id long, record_type string, refers_to long, claimed string, payload_bytes long, payload_digest string, payload binary"


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the index, read back from the bundles a frame at a time: what its head claims as digest, and the length and digest
    of the payload that is there. A revisit has neither these nor a payload; without payloads they are measured and left behind."""

    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("claimed", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
        held = (None, None, None, -1, b"")
        for batch in batches:
            out, size = [], 0
            for x in batch.to_pylist():
                if held[0] != x["bundle"]:
                    if held[1] is not None:
                        held[1].close()
                    file = open_bundle(x["bundle"])
                    held = (x["bundle"], file, read_seek_table(file), -1, b"")
                if held[3] != x["frame"]:
                    held = (*held[:3], x["frame"], read_frame(held[1], held[2], x["frame"]))
                fields, block = parse_record(held[4][x["start"] : x["start"] + x["length"]])
                kind = fields["WARC-Type"]
                own = block if kind == "response" else None
                measured = (None, None) if own is None else (len(own), hashlib.sha256(own).hexdigest())
                out.append({"page_id": number(fields["WARC-Record-ID"]), "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "claimed": fields["WARC-Payload-Digest"][7:], "payload_bytes": measured[0], "payload_digest": measured[1], "payload": own if payloads else None})
                size += len(block) if payloads else 0
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held[1] is not None:
            held[1].close()

    ordered = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "start")
    return ordered.mapInArrow(read, READ)


def round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = False, **how) -> DataFrame:
    """Write pages as bundles and read them back: page_id, record_type, refers_to, payload_bytes, payload_digest and, asked for, payload (null in revisits)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    told = read_bundles(write_bundles(plan_records(pages, **how), folder), payloads)
    told = told if payloads else stash(told.drop("payload"), "warc-read")
    held = told.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("r_id"), F.col("claimed").alias("r_claimed")).agg(F.max(F.struct(F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))).alias("r"))
    out = told.join(held, (F.col("refers_to") == F.col("r_id")) & (F.col("claimed") == F.col("r_claimed")), "left")
    return out.select("page_id", "record_type", "refers_to", F.coalesce("payload_bytes", "r.n").alias("payload_bytes"), F.coalesce("payload_digest", "r.d").alias("payload_digest"), *(["payload"] if payloads else []))


ship(__name__)
