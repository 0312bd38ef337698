"""Texts of an Arrow batch as flat numpy arrays: words, hashes and code points.

Everything works on whole batches at once. A batch is cut into slices of a few
megabytes between documents, so memory does not follow the batch size; a longer
document makes a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
# Ranges up to this length are hashed by running sums, a polynomial modulo 2**64. Longer ones
# could be made to collide, whatever the base, and get a digest each.
SHORT = 256
PIECE = 1 << 20  # bytes whose running sums are held at a time
# Space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(maxsize=None)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base or of its inverse, modulo 2**64."""
    key = "down" if inverse else "up"
    known = _powers.get(key)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE)
        steps[0] = 1
        known = np.cumprod(steps)
        if n <= SLICE_BYTES + SHORT:  # longer ones are not kept by the worker
            _powers[key] = known
    return known[:n]


@lru_cache(maxsize=None)
def _is_word() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(SEPARATORS)] = False
    return table


class Texts:
    """Bytes of several documents, one behind the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end byte and document of every word."""
        inside = _is_word()[self.data]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.offsets[:-1][self.offsets[:-1] < n]] = False
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return start, end, self.doc_of(start)

    def prefix_hash(self, lower: bool = False) -> np.ndarray:
        """Running sums from which the hash of any range follows in one step."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_byte_values(lower)[self.data] * powers(len(self.data)), out=sums[1:])
        return sums

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hash of each byte range; equal bytes have equal hashes anywhere."""
        out = np.empty(len(start), np.uint64)
        length = end - start
        short = length <= SHORT
        piece = start // PIECE
        for at in range(0, max(len(self.data), 1), PIECE):
            here = np.flatnonzero(short & (piece == at // PIECE)) if len(self.data) > PIECE else np.flatnonzero(short)
            if len(here):
                some = Texts(self.data[at : at + PIECE + SHORT], self.offsets[:0])
                out[here] = range_hash(some.prefix_hash(lower), start[here] - at, end[here] - at)
            if len(self.data) <= PIECE:
                break
        for i in np.flatnonzero(~short):
            out[i] = digest(self.data[start[i] : end[i]], lower)
        return out


def digest(data: np.ndarray, lower: bool = False) -> int:
    """64 bits of a digest of a long range."""
    text = data.tobytes()
    return int.from_bytes(hashlib.blake2b(text.lower() if lower else text, digest_size=8).digest(), "little")


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of short ranges of a text by its running sums."""
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start])


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """First row, end row and texts of each slice of a column."""
    if not len(column):
        return
    data, offsets = text_arrays(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def code_points(texts: Texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all documents and the offsets of each."""
    parts = [texts.text(i).decode("utf-8", "replace") for i in range(len(texts))]
    if lower:
        parts = [p.lower() for p in parts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32), offsets


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of several ranges, one behind the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
