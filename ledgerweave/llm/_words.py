"""Vectorised word splitting and hashing over Arrow string batches.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  Each
text is followed by one blank in the joined buffer, so no word spans two texts.
"""

from __future__ import annotations

import ctypes
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on every other."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = tuple(out)
        if size <= CHUNK_BYTES * 2:
            _POWERS[which] = have
    return have


def give_back_memory() -> None:
    """Make large arrays return to the system when they are freed: workers are used again by later stages."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def pieces(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES):
    """(first row, list of bytes) for consecutive rows of at most limit bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first, before = 0, 0
    while first < len(ends):
        stop = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, [x or b"" for x in texts.slice(first, stop - first).cast(kind).to_pylist()]
        first, before = stop, int(ends[stop - 1])


class Words:
    """Words of a list of texts: byte ranges in ``buf`` and, for text i, words first[i]:first[i+1]."""

    def __init__(self, rows: list[bytes], lower: bool = False):
        self.buf = np.frombuffer(b" ".join(rows) + b" ", dtype=np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        lens = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        self.text_at = np.concatenate(([0], np.cumsum(lens + 1)))
        blank = _BLANK[self.buf]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.text_at)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def prefix(self) -> np.ndarray:
        up, _ = powers(0, len(self.buf))
        sums = np.empty(len(self.buf) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_TABLE[self.buf] * up[: len(self.buf)], out=sums[1:])
        return sums

    def hashes(self, sums: np.ndarray | None = None, longest: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `longest` bytes."""
        sums = self.prefix() if sums is None else sums
        _, down = powers(0, len(self.buf))
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        h = (sums[ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (ends - self.starts).astype(np.uint64))

    def spaced(self, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
        """Kept words, each with one blank after it, and the offsets of the words in that."""
        s, e = (self.starts, self.ends) if keep is None else (self.starts[keep], self.ends[keep])
        buf = self.buf.copy()
        buf[e] = 0x20
        step = np.zeros(len(buf) + 2, dtype=np.int8)
        step[s] += 1
        step[e + 1] -= 1
        mask = np.cumsum(step[: len(buf)], dtype=np.int8).astype(bool)
        return buf[mask].tobytes(), np.concatenate(([0], np.cumsum(e - s + 1)))


def windows(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of h[i:i+k] for each i; whoever calls leaves out those that cross texts."""
    n = len(h)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(which, n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((mix(h + U64(which)) if which else h) * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + U64(k))


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def planes(x: np.ndarray, n_bytes: int) -> np.ndarray:
    """The low bytes of each value, byte by byte, as zstd compresses them best."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T)


def unplanes(p: np.ndarray) -> np.ndarray:
    out = np.zeros((p.shape[1], 8), dtype=np.uint8)
    out[:, : p.shape[0]] = p.T
    return out.view("<u8").reshape(-1)


def narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative whole numbers in the smallest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


def groups(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.empty(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
