"""Texts of an Arrow batch as one run of bytes, for NumPy kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that a kernel works on at once; a longer text is one piece by itself.
PIECE = 1 << 20

U = np.uint64
_rng = np.random.default_rng(0x5EED)
#: One random word a byte value, and an odd base, for hashes of byte runs.
BYTE_WORD = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        most = max(n, PIECE + 1)
        for slot, b in enumerate((BASE, BASE_INV)):
            p = np.ones(1, np.uint64)
            step = b
            while len(p) < most:  # doubling: the next half is the first times b ** len
                p = np.concatenate([p, p * U(step & ((1 << 64) - 1))])
                step = step * step & ((1 << 64) - 1)
            _powers[slot] = p[:most]
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(buf: np.ndarray, words: np.ndarray = BYTE_WORD) -> np.ndarray:
    """n + 1 running sums from which any run's hash follows, see ``run_hash``."""
    p, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(words[buf] * p, out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [start, end), equal for equal runs wherever they stand."""
    _, inv = powers(len(sums))
    return mixed((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * U(0x2545F4914F6CDD1D))
