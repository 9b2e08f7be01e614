"""Vectorised text kernels shared by the llm operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so it can be found on UTF-8 bytes
without decoding.  Words are named by 64-bit hashes: a polynomial over random byte values, computed
for all words of a batch with one cumulative sum, then finalised.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

CHUNK_BYTES = 1 << 21
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: White space and all other ASCII characters that are neither letters nor digits.
_PLAIN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20260101)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_VALUE = np.random.Generator(np.random.PCG64(20260102)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C13
_pow: np.ndarray | None = None
_inv: np.ndarray | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if _pow is None or len(_pow) < n:
        size = max(n, CHUNK_BYTES + 65536)
        _pow, _inv = np.full(size, _R, np.uint64), np.full(size, pow(_R, -1, 1 << 64), np.uint64)
        _pow[0] = _inv[0] = 1
        _pow, _inv = np.multiply.accumulate(_pow), np.multiply.accumulate(_inv)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; a longer document is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents, and where each document's words start (one more entry than documents).

    lower: without regard to ASCII case.  plain: ASCII punctuation divides words too."""
    return word_spans(data, offsets, lower, plain)[:2]


def word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), and each word's first and last byte, counted from offsets[0]."""
    base, end = int(offsets[0]), int(offsets[-1])
    b = data[base:end]
    n = len(b)
    rel = offsets - base
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lower:
        b = _LOWER[b]
    edge = np.zeros(n + 1, dtype=bool)
    edge[rel] = True
    space = (_PLAIN if plain else _SPACE)[b]
    solid = ~space
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:]))
    power, inverse = _powers(n)
    total = np.cumsum(_BYTE_VALUE[b] * power[:n], dtype=np.uint64)
    first = np.where(starts > 0, total[starts - 1], np.uint64(0))
    h = mix((total[ends] - first) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, rel), starts, ends


def stems(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words without ASCII case and punctuation, and of their beginnings of the given sizes in bytes (of longer
    words); the document of each hash; and every document's number of words."""
    h, bounds, starts, ends = word_spans(data, offsets, lower=True, plain=True)
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(len(offsets) - 1), n_words)
    if not len(h):
        return h, doc, n_words
    b = _LOWER[data[int(offsets[0]) : int(offsets[-1])]]
    power, inverse = _powers(len(b))
    total = np.cumsum(_BYTE_VALUE[b] * power[: len(b)], dtype=np.uint64)
    first = np.where(starts > 0, total[starts - 1], np.uint64(0))
    hashes, docs = [h], [doc]
    for size in sizes:
        long_ = np.flatnonzero(ends - starts >= size)
        hashes.append(mix((total[starts[long_] + size - 1] - first[long_]) * inverse[starts[long_]] + np.uint64(size << 32)))
        docs.append(doc[long_])
    return np.concatenate(hashes), np.concatenate(docs), n_words


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of bytes from starts to before ends, for words those of words()."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[b] * power[: len(b)], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts - 1).astype(np.uint64))


def lowered(b: np.ndarray) -> np.ndarray:
    """Bytes with the letters A to Z lowered."""
    return _LOWER[b]


def give_back() -> None:
    """Returns freed memory to the machine: workers live on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of consecutive stretches."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and where each document's windows start.

    short: a document of 1 to n-1 words has one window, its whole sequence."""
    size = np.diff(bounds)
    count = np.maximum(size - n + 1, 0)
    if short:
        count = np.where((size > 0) & (size < n), 1, count)
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    total = int(out_bounds[-1])
    if total == 0:
        return np.zeros(0, np.uint64), out_bounds
    doc = np.repeat(np.arange(len(size)), count)
    at = bounds[:-1][doc] + (np.arange(total) - out_bounds[:-1][doc])
    out = np.zeros(total, np.uint64)
    for k in range(n):
        c = _PLACE_VALUE[k]
        if short:
            inside = at + k < bounds[1:][doc]
            out += np.where(inside, h[np.minimum(at + k, len(h) - 1)] * c, np.uint64(0))
        else:
            out += h[at + k] * c
    if short:
        out += np.minimum(size, n)[doc].astype(np.uint64)
    return mix(out), out_bounds


_zip = zstandard.ZstdCompressor(level=1)
_unzip = zstandard.ZstdDecompressor()


def squeeze(raw: bytes) -> bytes:
    return _zip.compress(raw)


def unsqueeze(blob: bytes) -> bytes:
    return _unzip.decompress(blob)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal weight stand together."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(f"{a.dtype.str},{len(a)}")
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 and len(a) else a.tobytes())
    top = ";".join(head).encode()
    return _zip.compress(len(top).to_bytes(4, "little") + top + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _unzip.decompress(blob)
    size = int.from_bytes(raw[:4], "little")
    at, out = 4 + size, []
    for part in raw[4:at].decode().split(";"):
        kind, n = part.split(",")
        dtype, n = np.dtype(kind), int(n)
        width = dtype.itemsize
        body = np.frombuffer(raw, np.uint8, n * width, at)
        at += n * width
        out.append(np.ascontiguousarray(body.reshape(width, n).T).view(dtype).reshape(n) if width > 1 and n else body.view(dtype))
    return out


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of ascending values, for pack()."""
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def undeltas(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=d.dtype)
