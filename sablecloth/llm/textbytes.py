"""Vectorised text handling shared by the operators of this subpackage.

Texts are held as one UTF-8 byte array with document offsets, as Arrow holds
them.  Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; the bytes of
one word are hashed eight at a time, so the cost is per word and not per byte.
A null text counts as the empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_C1, _C2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Odd multipliers by which the words of a shingle are told apart by place.
_PLACES = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1 for i in range(1, 65)], dtype=U64)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=U64)
#: Space is 0x20, the rest of the white space 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are handled at once; one longer document is handled alone.
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place if it can)."""
    x = x ^ (x >> U64(30))
    x *= _C1
    x ^= x >> U64(27)
    x *= _C2
    x ^= x >> U64(31)
    return x


def mix1(x: int) -> int:
    return int(mix(np.array([x % 2**64], dtype=U64))[0])


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins (n + 1 offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    n = len(column)
    if n == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(ends, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges of about `most` bytes."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def padded(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """A copy with eight spare bytes, so that eight can be read anywhere."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[: len(data)] = _LOWER[data] if lower else data
    return out


def char_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    return np.diff(prefix((data & 0xC0) != 0x80)[off])


def prefix(flags: np.ndarray) -> np.ndarray:
    """Sums of what stands before each place, and of all."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the first word of each row (n + 1 places)."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    edge = solid[1:] != solid[:-1]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True  # a row's start parts words too
    starts = np.flatnonzero(solid[1:] & (edge | first))
    cut = solid[:-1] & (edge | first)
    ends = np.flatnonzero(cut)
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(pad: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; distinct for spans of up to seven bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    view = np.ndarray((len(pad) - 7,), "<u8", pad, 0, (1,))
    size = ends - starts
    left = np.minimum(size, 8)
    out = mix((view[starts] & _MASKS[left]) + U64(0x9E3779B97F4A7C15) * left.astype(U64))
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        left = np.minimum(size[more] - at, 8)
        out[more] = mix((out[more] * _PLACES[0]) ^ (view[starts[more] + at] & _MASKS[left]) ^ (left.astype(U64) << U64(56)) * _PLACES[1])
        at += 8
        more = more[size[more] > at]
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within rows, and the row of each.

    A row of fewer than k words, but not without words, has one shingle: the
    whole sequence."""
    n_words, n = np.diff(first), len(hashes)
    value = np.zeros(max(n, 1), U64)
    for j in range(k):
        value[: max(n - j, 0)] += hashes[j:] * _PLACES[j]
    short = (n_words > 0) & (n_words < k)
    count = np.maximum(n_words - k + 1, 0) + short
    begin = prefix(count)
    row = np.repeat(np.arange(len(n_words)), count)
    at = np.arange(len(row)) - begin[:-1][row] + first[:-1][row]
    out = value[at] if len(at) else np.zeros(0, U64)
    for i in np.flatnonzero(short):
        own = hashes[first[i] : first[i + 1]]
        tail = np.array([len(own)], U64) * _PLACES[63]  # an array wraps silently where a scalar warns
        out[begin[i]] = ((own * _PLACES[: len(own)]).sum(dtype=U64) + tail)[0]
    return mix(out), row


def keyed_by_row(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts; a key holds the row in its upper
    twelve bits and the upper 52 bits of the value below.  At most 4,096 rows."""
    key = np.sort((row.astype(U64) << U64(52)) | (values >> U64(12)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at], np.diff(np.append(at, len(key)))


def text_at(data: np.ndarray, off: np.ndarray, i: int) -> bytes:
    return data[off[i] : off[i + 1]].tobytes()
