"""SentencePiece encoding and decoding, with forward states shared along a trie of words.

The text is normalised as the model's identity rules have it (a marker in front, every space a marker) and cut into marked
words: no piece spans from a word's letters into the next marker, so words are encoded apart. The different words of a batch are sorted,
which is the depth-first order of their trie, and a stack holds the forward state of each prefix; the next word
goes on from the longest prefix it shares with the one before.

The given model is of the byte-pair kind, whose segmentation is not the one of the highest sum of scores, so
a Viterbi maximum over scores would give other ids than the model defines. The forward state of a prefix is
therefore its last piece under the model's own merges: among the pieces that end a prefix exactly one can follow the last
piece of the prefix before it, namely that which merging the two pieces' letters alone leaves apart. Following those
states back gives the model's segmentation. Characters outside the vocabulary become byte pieces.

A null text is encoded as an empty one: no ids. Each row is encoded by itself: ties, repeated rows and extra columns, whatever their names, don't matter. A very long
text is cut into words like any other. An empty table gives an empty result. Memory is one Arrow batch, its different words and two caches of bounded size. The model is read once on the driver and sent as one broadcast of fixed size.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame

from .common import free_name, ship, text_of

MARK = "▁"
#: Words and pairs of pieces that a task remembers; bytes of text whose words are sorted at once.
CACHE, STEP = 200_000, 3 << 20
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    """Encoder and decoder for one byte-pair model. pieces: list of (piece, score, kind), kind being 'piece', 'byte' or 'other'."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.score = {p: s for p, s, kind in pieces if kind == "piece"}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "piece"}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.raw = [p.replace(MARK, " ").encode() if kind == "piece" else bytes([int(p[3:5], 16)]) if kind == "byte" else b"" for p, _, kind in pieces]
        self.known: dict[str, tuple[int, ...]] = {}
        self.follows: dict[int, bool] = {}
        self.text = [p for p, _, _ in pieces]
        #: Pieces that merging makes of their own letters; the others never come out.
        self.made = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        self.tails = {p[k:] for p in self.made for k in range(len(p))}

    @classmethod
    def load(cls, path: str) -> Codec:
        return cls(read_model(path))

    def merge(self, word: str) -> list[str]:
        """The model's merges, best score first, then leftmost."""
        part, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := self.score.get(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not part[i] or not part[j] or after[i] != j or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, "", after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p]

    def may_follow(self, a: int, b: int) -> bool:
        x, y = self.text[a], self.text[b]
        if len(self.follows) >= 2 * CACHE:
            self.follows.clear()
        found = self.follows[a << 24 | b] = self.merge(x + y) == [x, y]
        return found

    def strange(self, char: str) -> int:
        """A number for a character outside the vocabulary; it is a piece of its own."""
        if len(self.text) >= 1 << 23:
            raise MemoryError("more strange characters than Unicode has")
        self.made[char] = len(self.text)
        self.text.append(char)
        return self.made[char]

    def extend(self, word: str, last: list[int]) -> None:
        """Forward states of word's prefixes: last[i] is the last piece of word[: i + 1]; those at hand are kept."""
        made, tails, follows = self.made, self.tails, self.follows
        for end in range(len(last) + 1, len(word) + 1):
            start = end - 1
            piece = word[start]
            if piece not in made:
                self.strange(piece)
            while True:
                i = made.get(piece)
                if i is not None:
                    if not start:
                        break
                    ok = follows.get(last[start - 1] << 24 | i)
                    if ok or ok is None and self.may_follow(last[start - 1], i):
                        break
                start -= 1
                if start < 0 or (piece := word[start:end]) not in tails:
                    raise ValueError(f"no piece ends {word[:end]!r}")
            last.append(i)

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(i)
        return out

    def ids_back(self, last: list[int]) -> list[int]:
        """The pieces of the whole word, from its forward states."""
        out, at, text, own = [], len(last), self.text, len(self.raw)
        while at:
            i = last[at - 1]
            if i < own:
                out.append(i)
            else:
                out += [self.byte[b] for b in reversed(text[i].encode())]
            at -= len(text[i])
        out.reverse()
        return out

    def encode_words(self, words: set[str]) -> None:
        """Fill known for these words: sorted, they are their trie in depth-first order."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(words)
        new.sort()
        last: list[int] = []
        before = ""
        for word in new:
            if word.startswith(MARK * 2):  # markers only merge among themselves and with a word's start
                self.known[word] = tuple(self.to_ids(self.merge(word)))
                continue
            shared = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del last[shared:]
            self.extend(word, last)
            before = word
            self.known[word] = tuple(self.ids_back(last))

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [CHUNKS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.encode_words({w for words in split for w in words})
        known, out = self.known, []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace") if ids else ""


def read_model(path: str) -> list[tuple[str, float, str]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.vocab_size())]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with the token_ids (array<int>) of the model at that path and decoded (the ids' text); underscored where docs has such names."""
    names = docs.columns
    token_ids, decoded = free_name(names, "token_ids"), free_name(names, "decoded")
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        codec = Codec(sent.value)
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_string())), 0)))
            at = 0
            while at < batch.num_rows:
                most = (sizes[at - 1] if at else 0) + STEP
                end = max(at + 1, int(np.searchsorted(sizes, most, side="right")))
                part = batch.slice(at, end - at)
                at = end
                ids = codec.encode_batch([t or "" for t in part.column(text).to_pylist()])
                ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                flat = pa.array(np.fromiter(chain.from_iterable(ids), dtype=np.int32))
                decoded_text = pa.array([codec.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, flat), decoded_text], names=[*names, token_ids, decoded])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(token_ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    return docs.mapInArrow(run, schema)


ship(__name__)
