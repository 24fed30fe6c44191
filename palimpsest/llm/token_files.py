"""Token ids in flat binary files with 64-bit document offsets.

Rows are put in order of doc_id (nulls last; rows of one id by a hash of their text, then by the text) by a range shuffle, and a task writes its range as two files:

* `.ids`: the ids one after the other, little-endian unsigned integers of WIDTH bytes, the narrowest of 2 and 4 that holds the vocabulary and the end id;
* `.idx`: a head (MAGIC, width, documents, documents with an id), documents + 1 unsigned 64-bit offsets into `.ids`, counted in ids, and the doc_ids as signed 64-bit integers.

A task counts its own ids only. The manifest, a row a file, gives each file its base by a prefix sum over the files before it, so that a document starts at base + offset,
and no file is written again. Its window runs in one task over one row a file. Files are read by memory maps where the file system is a local one and by ranges elsewhere.

Ids come from the tokenizers library. Where the tokenizer's own file says that no token reaches over white space or from a word to the punctuation after it (NORMALIZER, PIECES), a task has the library encode
each distinct piece between such borders once; a worker keeps at most CACHE pieces' ids, over its tasks. Otherwise whole texts are encoded. Special tokens' strings in a text become these tokens, as in the library.

Null text is empty: the end id alone. Very long texts are one document each and pass in memory alone; a word of any length is one piece. Rows that repeat are written each,
next to each other; a third of all rows that repeat whole are still dealt over many tasks, by their place in the input. An empty table gives an empty manifest. Extra columns
are left alone, whatever their names. Each attempt of a task writes files of its own name and the manifest names those of the attempt that was committed; others may be deleted.
"""

from __future__ import annotations

import json
import struct
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, ship, stash, text_of

MAGIC, HEAD = b"PLMTOKN1", "<8sQQQ"
_HEAD = struct.calcsize(HEAD)
CACHE, JOIN, STEP, DOCS = 1 << 20, 4096, 4 << 20, 4096
#: Fixed values of the tokenizer family whose tokens never reach over white space, nor from a letter or digit to punctuation (but for apostrophes).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Where a text is cut besides at ASCII white space: between a letter or digit of Latin-1 (others may end in a combining mark, once normalised) and ASCII punctuation, of which "'" and
#: what special tokens consist of are left out.
BORDER = r"([A-Za-z0-9À-ÖØ-öø-ÿ])([!-&(-/:;=?@\[-`{}~])"
MARK = "\x00"


class Encoder:
    """Ids of texts: each distinct piece of a text is encoded once and its ids are kept in one array."""

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        told = json.loads(model)
        self.by_piece = told.get("normalizer") == NORMALIZER and ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [None])[0] == PIECES
        mark = self.of(MARK)
        self.mark = mark[0] if len(mark) == 1 else -1
        self.forget()

    def of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and how many each text has, as the library tells."""
        found = [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.concatenate([np.zeros(0, dtype=np.uint32), *found]), sizes

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = (np.zeros(0, dtype=t) for t in ("uint32", "int64", "int64"))

    def learn(self, new: list[str]) -> None:
        """Have the library encode new pieces, JOIN of them as one text with a mark between, or each alone where a piece holds the mark."""
        for at in range(0, len(new), JOIN):
            part = new[at : at + JOIN]
            if self.mark < 0 or any(MARK in w for w in part):
                ids, size = self.batch(part)
            else:
                every = self.batch([f" {MARK} ".join(part)])[0]
                ends = np.append(np.flatnonzero(every == self.mark), len(every))
                if len(ends) != len(part):
                    raise ValueError("a piece has the mark's id")
                ids, size = every[every != self.mark], np.diff(ends, prepend=-1) - 1
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of strings in one array, and how many each text has."""
        import pyarrow.compute as pc

        if not self.by_piece:
            return self.batch(texts.to_pylist())
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special token's string, which case would matter for
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, BORDER, r"\1 \2"))
        each = np.diff(np.asarray(words.offsets))
        told = words.flatten().dictionary_encode()
        pieces = told.dictionary.to_pylist()
        new = [w for w in pieces if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.forget()
            new = pieces
        self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        at = number[np.asarray(told.indices)]
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat((self.start[at] - ends + size).astype(np.int32), size) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(each)])])


def kept_encoder(model: str) -> Encoder:
    """The encoder of this Python worker, which stays from task to task with the pieces that it knows; one at a time."""
    held = sys.modules.setdefault("palimpsest_worker", types.ModuleType("palimpsest_worker"))
    if getattr(held, "model", None) != model:
        held.model, held.encoder = model, Encoder(model)
    return held.encoder


def slices(batch, text: int) -> Iterator:
    """Runs of texts of about STEP bytes, or one text, as arrays of strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(batch.column(text), "").cast(pa.large_string())
    ends = np.cumsum(np.asarray(pc.binary_length(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
        yield column.slice(at, end - at)
        at = end


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with the end id after them, and their numbers."""
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


WRITTEN = "part long, ids_path string, idx_path string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, model: str, folder: str | None = None, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of docs with the tokenizer file at the path `model`, and return the manifest: part, ids_path, idx_path, n_docs, n_ids, base_docs, base_ids."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    from tokenizers import Tokenizer

    with open(model, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    width = 2 if max(Tokenizer.from_str(sent.value).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        task, encoder, file = TaskContext.get(), None, None
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        sizes, ids_of, named = [], [], 0
        for batch in batches:
            own = batch.column(0)
            for texts in slices(batch, 1):
                if file is None:
                    system.create_dir(root, recursive=True)
                    encoder, file = kept_encoder(sent.value), system.open_output_stream(f"{root}/{name}.ids", compression=None)
                ids, n = with_end(*encoder.encode(texts), end_id)
                file.write(ids.astype(f"<u{width}").tobytes())
                sizes.append(n)
            ids_of.append(own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            named += batch.num_rows - own.null_count
        if file is None:
            return
        file.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        with system.open_output_stream(f"{root}/{name}.idx", compression=None) as f:
            f.write(struct.pack(HEAD, MAGIC, width, len(offsets) - 1, named) + offsets.tobytes() + np.concatenate(ids_of).tobytes())
        row = {"part": task.partitionId(), "ids_path": f"{folder}/{name}.ids", "idx_path": f"{folder}/{name}.idx", "n_docs": len(offsets) - 1, "n_ids": int(offsets[-1])}
        yield pa.RecordBatch.from_pylist([row])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("text")).withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    # what repeats whole lies side by side in any order: its place only deals it out
    dealt = rows.repartitionByRange(F.asc_nulls_last("doc_id"), "h", "place").sortWithinPartitions(F.asc_nulls_last("doc_id"), "h", "text")
    written = stash(dealt.select("doc_id", "text").mapInArrow(write, WRITTEN), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    return written.withColumns({"base_docs": base("n_docs"), "base_ids": base("n_ids")})


class TokenFile:
    """One pair of files; local ones are mapped into memory, of others only what is asked for is read."""

    def __init__(self, ids_path: str, idx_path: str):
        import pyarrow as pa
        from pyarrow import fs

        def open_file(path):
            system, place = fs.FileSystem.from_uri(path)
            return pa.memory_map(place) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)

        self.ids, index = open_file(ids_path), open_file(idx_path)
        magic, self.width, self.n_docs, self.named = struct.unpack(HEAD, index.read_at(_HEAD, 0))
        if magic != MAGIC or self.width not in (2, 4):
            raise ValueError(f"{idx_path} is no index of token ids")
        self.offsets = np.frombuffer(index.read_at(8 * (self.n_docs + 1), _HEAD), dtype="<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(index.read_at(8 * self.n_docs, _HEAD + 8 * (self.n_docs + 1)), dtype="<i8")
        if self.width * int(self.offsets[-1]) != self.ids.size():
            raise ValueError(f"{ids_path} has not the length that its index tells")

    def tokens(self, k: int) -> np.ndarray:
        lo, hi = int(self.offsets[k]), int(self.offsets[k + 1])
        return np.frombuffer(self.ids.read_at(self.width * (hi - lo), self.width * lo), dtype=f"<u{self.width}")


def read_tokens(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, asked for, the ids of each document, from the files of the manifest."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def read(batches: Iterator) -> Iterator:
        from zlib import crc32

        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["ids_path"], row["idx_path"])
                for at in range(0, file.n_docs, DOCS if not ids else DOCS // 16):
                    ks = range(at, min(file.n_docs, at + (DOCS if not ids else DOCS // 16)))
                    doc_ids = pa.array(file.doc_ids[ks.start : ks.stop], pa.int64(), mask=np.asarray(ks) >= file.named)
                    spans = file.offsets[ks.start : ks.stop + 1]
                    crc = [crc32(file.tokens(k).astype("<u4").tobytes()) for k in ks]
                    out = [doc_ids, pa.array(row["base_ids"] + spans[:-1], pa.int64()), pa.array(np.diff(spans), pa.int64()), pa.array(crc, pa.int64())]
                    if ids:
                        out.append(pa.array([file.tokens(k).astype(np.int64) for k in ks], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, names=names)

    files = manifest.select("ids_path", "idx_path", "base_ids", "part")
    n = max(1, manifest.count())
    return files.repartitionByRange(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


ship(__name__)
