"""Sets of hashed word shingles for whole batches of texts, in numpy.

A word's hash is a polynomial of random bytes' values over its (A-Z lower-cased) bytes, taken from running sums over the batch, then mixed;
words of over LONG bytes are hashed by themselves with a sound hash, because polynomials modulo 2^64 have known collisions on
long strings. A shingle mixes the hashes of its words.
"""

from __future__ import annotations

import numpy as np

from .common import ship

LONG = 256
_RNG = np.random.default_rng(20)
_BASE = int(_RNG.integers(1 << 62)) * 8 + 5
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TURN = _RNG.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(0x5851F42D4C957F2D)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts data[offsets[i]: offsets[i + 1]], and how many each text has."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = np.flatnonzero(ink & np.concatenate([[True], ~ink[:-1] | edge[1:-1]]))
    last = np.flatnonzero(ink & np.concatenate([~ink[1:] | edge[1:-1], [True]])) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    out = mix((total[last] - total[first]) * down[first])
    for i in np.flatnonzero(last - first > LONG):
        import hashlib

        low = data[first[i] : last[i]].copy()
        low[(low >= 65) & (low <= 90)] += 32
        out[i] = int.from_bytes(hashlib.blake2b(low.tobytes(), digest_size=8).digest(), "little")
    return out, np.diff(np.searchsorted(first, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted different shingle hashes; fewer words than width are one shingle, none is an empty set."""
    words, count = word_hashes(data, offsets)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    rolled = np.zeros(len(words), dtype=np.uint64)
    for k in range(width):
        rolled += padded[k : k + len(words)] * _TURN[k % len(_TURN)]
    rolled = mix(rolled)
    out, at = [], 0
    for c in count:
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            few = np.full(width, _NONE)
            few[:c] = words[at : at + c]
            out.append(mix((few * _TURN[:width]).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


def steps(column, most: int):
    """(from, to, sets) for runs of rows of about `most` bytes."""
    data, offsets = text_buffers(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end, shingle_sets(data, offsets[at : end + 1])
        at = end


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted unsigned integers as byte planes of their differences, compressed."""
    import zstandard

    d = np.diff(sorted_values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Small unsigned integers in any order as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_counts(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


def add_up(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, sorted, and the sums of their times."""
    if not len(values):
        return values, times
    order = np.argsort(values, kind="stable")
    values, times = values[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(times, first)


def release() -> None:
    """Give freed memory back to the system; Python workers are kept and reused after a task."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


ship(__name__)
