"""Vectorised scans of text columns: Arrow buffers in, numpy arrays out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The ASCII white space of the word rules: 0x20 and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), applied to each element."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


#: A 64-bit code for each byte value, so that the polynomial below isn't over small integers.
CODES = mix(np.arange(1, 257, dtype=np.uint64) * U(_ODD))
#: Odd bases of the polynomial; two of them make a print of 128 bits.
BASES = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers up to here are kept between calls; a longer text gets its own.
KEPT = (1 << 20) + 2


def _series(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    inverse = pow(base, -1, 1 << 64)
    if n >= KEPT:
        return _series(base, n + 1), _series(inverse, n + 1)
    if base not in _powers or len(_powers[base][0]) <= n:
        size = KEPT if n >= 1 << 16 else 1 << 16
        _powers[base] = _series(base, size), _series(inverse, size)
    return _powers[base]


class RollingHash:
    """Prefix sums of a polynomial over one buffer; the hash of any slice costs two look-ups."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        self.up, self.down = powers(len(data) + 1, base)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(CODES[data] * self.up[: len(data)], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])


#: Bytes of a text that the scans below hold arrays for at a time.
PIECE = 1 << 20


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """RollingHash(data).of(starts, ends) for ascending starts and ends, with arrays of one piece of a long buffer at a time."""
    if len(data) <= PIECE:
        return RollingHash(data).of(starts, ends)
    opens, closes, down = (np.empty(len(starts), np.uint64) for _ in range(3))
    carry, up_base, down_base = U(0), U(1), U(1)
    up, inverse = powers(PIECE)
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(CODES[part] * up[: len(part)], out=prefix[1:])
        prefix = prefix * up_base + carry
        i, j = np.searchsorted(starts, [at, at + len(part)])
        opens[i:j], down[i:j] = prefix[starts[i:j] - at], inverse[starts[i:j] - at] * down_base
        i, j = np.searchsorted(ends, [at, at + len(part)], "right")
        closes[i:j] = prefix[ends[i:j] - at]
        carry = prefix[-1]
        with np.errstate(over="ignore"):
            up_base, down_base = up_base * up[PIECE], down_base * inverse[PIECE]
    return mix((closes - opens) * down)


def slices(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most `rows` rows with about `most` bytes; a longer text is a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(len(column), max(end, at + 1), at + rows)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def pack_rows(x: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Places and values of the rows of a matrix that aren't zero, as two columns of bytes."""
    at = [np.flatnonzero(row).astype(np.uint16) for row in x]
    return pa.array([a.tobytes() for a in at], pa.binary()), pa.array([row[a].astype(np.float32).tobytes() for row, a in zip(x, at, strict=True)], pa.binary())


def unpack_rows(rows: list[tuple[bytes, bytes]], places: int) -> np.ndarray:
    """The matrix of packed rows."""
    x = np.zeros((len(rows), places), np.float32)
    for k, (at, value) in enumerate(rows):
        x[k, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-white bytes, and each run's row; a run never crosses rows."""
    if not len(data):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    solid = ~WHITE[data]
    opens = np.empty(len(data), bool)
    opens[0] = True
    opens[1:] = ~solid[:-1]
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(opens & solid)
    closes = np.empty(len(data), bool)
    closes[-1] = True
    closes[:-1] = ~solid[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    closes[ends] = True
    return starts, np.flatnonzero(closes & solid) + 1, np.searchsorted(offsets, starts, "right") - 1


#: Words above this many bytes are hashed whole: a polynomial modulo a power of two has known collisions of long words.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at starts to ends: by the polynomial, or for long words by blake2b."""
    hashes = slice_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return hashes


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its `width`-word shingles, A-Z lower-cased.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n + 1))
    keys = mix(np.arange(1, width + 1, dtype=np.uint64) * U(_ODD)) | U(1)
    total = max(0, len(hashes) - width + 1)
    joined = np.zeros(total, np.uint64)
    for k in range(width):
        joined += hashes[k : k + total] * keys[k]
    joined = mix(joined)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            yield np.unique(joined[a : b - width + 1])
        elif b > a:
            length = np.array([b - a], np.uint64) * U(_ODD)
            yield mix((hashes[a:b] * keys[: b - a]).sum(dtype=np.uint64, keepdims=True) + length)
        else:
            yield np.zeros(0, np.uint64)
