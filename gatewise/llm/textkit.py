"""Vectorised text kernels over Arrow batches: word bounds and hashes of whole texts.

A block is (offsets, bytes) of some consecutive texts of one Arrow batch, about
``BLOCK_BYTES`` long (one text at least), so that the temporary arrays stay small
whatever the batch holds. Null texts have no bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64
#: Single-byte white space: a word is a run of other bytes; no byte of a longer UTF-8 character is among them.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Spans of more bytes are hashed and compared one by one.
LONG_SPAN = 64
_LANE_MASKS = np.array([2 ** (8 * n) - 1 for n in range(9)], U64)
_BASE, _BASE_INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of each block of a string array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, "right")) - 1)
        last = min(last, n)
        yield first, at[first : last + 1] - at[first], data[at[first] : at[last]]
        first = last


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ U64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % 2**64)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def _powers_to(n: int, base: np.uint64) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def word_bounds(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and of the end) of all words of a block."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:n]
    ends = word
    ends = ends & np.concatenate([~word[1:] | edge[1:n], [True]])
    starts = np.nonzero(starts)[0]
    return starts, np.nonzero(ends)[0] + 1, np.searchsorted(starts, off)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (unaligned, no copy of each); zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand.

    Eight bytes at a time are folded in by a mixer that isn't linear, so repetitive spans differ like any others;
    spans of more than ``LONG_SPAN`` bytes are hashed by BLAKE2. Hashes of two salts are independent.
    """
    size = ends - starts
    h = mix(size.astype(U64), salt)
    lanes, live, at = _lanes(data), slice(None), 0
    while at < LONG_SPAN:
        left = np.minimum(size[live] - at, 8)
        h[live] = mix(h[live] ^ (lanes[starts[live] + at] & _LANE_MASKS[left]), salt)
        at += 8
        live = np.nonzero(size > at)[0]
        if not len(live):
            return h
    key = struct.pack("<q", salt)
    for i in np.nonzero(size > LONG_SPAN)[0]:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return h


def same_bytes(left: np.ndarray, left_starts: np.ndarray, right: np.ndarray, right_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of ``size`` bytes in two arrays are equal."""
    same = np.ones(len(size), bool)
    a, b, at = _lanes(left), _lanes(right), 0
    live = np.nonzero(size > 0)[0]
    while len(live) and at < LONG_SPAN:
        mask = _LANE_MASKS[np.minimum(size[live] - at, 8)]
        same[live] = (a[left_starts[live] + at] & mask) == (b[right_starts[live] + at] & mask)
        at += 8
        live = live[(size[live] > at) & same[live]]
    for i in live:
        same[i] = np.array_equal(left[left_starts[i] : left_starts[i] + size[i]], right[right_starts[i] : right_starts[i] + size[i]])
    return same


def pair_hash(left: np.ndarray, right: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the pair of two hashed halves."""
    return mix(left * U64(0xA24BAED4963EE407) + mix(right, salt + 1), salt)


def window_hashes(h: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of ``length`` consecutive items at each start, by doubling; shorter than ``h`` by length - 1."""
    have = 1
    while have < length:
        step = min(have, length - have)
        h = pair_hash(h[:-step], h[step:], salt + have) if len(h) > step else h[:0]
        have += step
    return h


def byte_windows(data: np.ndarray, length: int, table: np.ndarray) -> np.ndarray:
    """Hash of ``length`` consecutive bytes at each start, from running sums; ``table`` has a number for each byte.

    For short windows alone: from about 1,000 bytes on, sums of powers are equal for some repetitive strings.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * _powers_to(len(data), _BASE), out=total[1:])
    h = total[length:] - total[:n]
    h *= _powers_to(n, _BASE_INVERSE)
    return mix(h)


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each run of ``width`` items."""
    n = len(x)
    if n < width:
        return x[:0]
    ufunc, fill = (np.minimum, np.iinfo(x.dtype).max) if least else (np.maximum, 0)
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    fore = ufunc.accumulate(rows, 1).ravel()
    back = ufunc.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return ufunc(back[: n - width + 1], fore[width - 1 : n])


def sampled(h: np.ndarray, width: int) -> np.ndarray:
    """Starts that hold the least hash of some run of ``width`` consecutive starts.

    Which start a run picks depends on the run's content alone, so equal runs pick
    equal hashes: every run that occurs twice has a pick that occurs twice.
    """
    low = sliding(h, width, True)
    if not len(low):
        return np.zeros(len(h), bool)
    spread = np.concatenate([np.zeros(width - 1, h.dtype), low, np.zeros(width - 1, h.dtype)])
    return sliding(spread, width, False) == h


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64, copy=False))
