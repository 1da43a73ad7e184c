"""Vectorised tokenising of UTF-8 text: word bounds and 64-bit hashes by numpy, straight from Arrow buffers.

Both word patterns of this subpackage are unions of byte classes, so they can be applied to UTF-8 bytes: every byte
from 0x80 up belongs to a word. Words never cross rows. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text handled at once, but for longer single texts

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lowered
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_R = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _R.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INV = pow(BASE, -1, 1 << 64)
_MULT = _R.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n (mod 2**64); tables up to 4 Mi entries are kept."""
    k = max(20, (n + 1).bit_length())
    if k in _POW:
        return _POW[k]
    out = []
    for b in (BASE, INV):
        a = np.full(1 << k, b, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    if k <= 22:
        _POW[k] = (out[0], out[1])
    return out[0], out[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of byte hashes times BASE**j over j < i; a substring's hash is (P[e] - P[s]) * BASE**-s."""
    p = np.empty(len(data) + 1, np.uint64)
    p[0] = 0
    np.cumsum(_BYTE[data] * powers(len(data))[0][: len(data)], out=p[1:])
    return p


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


class Words:
    """Words of some rows: byte bounds, 64-bit hashes, and the index of each row's first word."""

    __slots__ = ("data", "starts", "ends", "hash", "first")

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray, hashes: bool = True):
        self.data = data = LOWER[data]
        n = len(data)
        w = kind[data]
        s, e = w.copy(), w.copy()
        if n:
            s[1:] &= ~w[:-1]
            e[:-1] &= ~w[1:]
            at = off[:-1][off[:-1] < off[1:]]  # rows with bytes: a word never runs on into the next row
            s[at] = w[at]
            last = off[1:][off[:-1] < off[1:]] - 1
            e[last] = w[last]
        self.starts, self.ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.starts, off)
        self.hash = None
        if hashes:
            p = prefix_hash(data)
            self.hash = mix((p[self.ends] - p[self.starts]) * powers(n)[1][self.starts])

    def row(self) -> np.ndarray:
        """Each word's row."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, one per start; starts too near the end are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _MULT[0]
    for j in range(1, k):
        out = out + h[j : j + n] * _MULT[j]
    return mix(out + np.uint64(k))


def combine(*cols: np.ndarray) -> np.ndarray:
    out = cols[0] * _MULT[0]
    for j, c in enumerate(cols[1:], 1):
        out = out + c * _MULT[j]
    return mix(out)


def slice_rows(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    return data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())
