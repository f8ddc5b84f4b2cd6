"""Vectorised word splitting and hashing on Arrow text buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D. A word's hash is
a 64-bit polynomial over its bytes, finished by an avalanche step; hashes of word
sequences are polynomials over word hashes. Everything works on whole columns, so
no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = (1 << 20) - 64  # tables of powers go up to the next power of two
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Also every ASCII sign other than letters and digits parts words here.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_SEQ = 0xD1342543DE82EF95 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                step = np.uint64(pow(b, len(table), 1 << 64))
                table = np.concatenate([table, table * step])
            out.append(table)
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Words of a few documents: byte bounds, document of each word, and word offsets of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        self.data = LOWER[data] if lower else data
        self.n_docs = len(offsets) - 1
        inside = ~space[data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = offsets[:-1]
            before[edges[edges < len(inside)]] = False
            edges = offsets[1:]
            after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, inverse = _powers(_BASE, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def text(self, i: int, j: int) -> bytes:
        """The bytes from word i to before word j, as they stand."""
        return self.data[self.starts[i] : self.ends[j - 1]].tobytes() if j > i else b""


def sequences(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries; the caller masks those that cross documents."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(_SEQ, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[:n])


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES, space: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over the column, a few MB of text at a time."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower, space)
        lo = hi


def to_binary(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value, the bytes of equal weight side by side, for zstd to find their likeness."""
    import pickle

    import zstandard

    parts = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"") for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(parts, protocol=5))


def expand(payload: bytes) -> list[np.ndarray]:
    import pickle

    import zstandard

    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(payload)):
        dtype = np.dtype(kind)
        flat = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1) if raw else np.zeros((dtype.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(flat.T).view(dtype).ravel())
    return out


def narrow(array: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    top = int(array.max()) if len(array) else 0
    return array.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of consecutive runs: starts[0], starts[0] + 1, ..., starts[1], ..."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


class Routes:
    """Entries of a block dealt to hash buckets, and what comes back for them, put in their own order again."""

    def __init__(self, keys: np.ndarray, buckets: int):
        # The high bits choose the bucket; the mixed key's low bits stay for sorting within it.
        self.bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        self.order = np.argsort(self.bucket, kind="stable")
        self.first = np.searchsorted(self.bucket[self.order], np.arange(buckets + 1))

    def __iter__(self):
        """(bucket, positions of its entries)"""
        for b in np.flatnonzero(np.diff(self.first)):
            yield int(b), self.order[self.first[b] : self.first[b + 1]]

    def back(self, returns: dict[int, np.ndarray], kind) -> np.ndarray:
        out = np.zeros(len(self.order), kind)
        for b, values in returns.items():
            out[self.order[self.first[b] : self.first[b + 1]]] = values
        return out
