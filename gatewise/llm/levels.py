"""Lengths that double up to a window, and the nested windows that a full window is followed through.

A full window (of words or bytes) samples, among the windows of the first length in it,
the one that hashes least, the leftmost of equals. From there on it is followed by one
window of each length: the one before, extended to twice its length to the right where
that stays in the full window, else to the left. Equal full windows are followed
through equal windows, so a full window can occur twice only if all of these do.
"""

from __future__ import annotations

import numpy as np

from . import textkit as tk

#: Starts whose samples are taken at once; a start's place within them fits the low bits of a key.
_RUN, _PLACE = 1 << 23, np.uint64((1 << 24) - 1)


def lengths(window: int, first: int) -> list[int]:
    """``window``, its half (rounded up) and so on down to ``first``, ascending."""
    out = [window]
    while out[-1] > max(first, 1):
        out.append(-(-out[-1] // 2))
    return out[::-1]


def sampled_places(h: np.ndarray, width: int) -> np.ndarray:
    """Of each run of ``width`` hashes: the place of the least one, by its upper 40 bits, the leftmost of equals."""
    found = []
    for at in range(0, max(len(h) - width + 1, 0), _RUN):
        part = h[at : at + _RUN + width - 1]
        keys = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        found.append((tk.sliding(keys, width, True) & _PLACE).astype(np.int64) + at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def followed(first_hashes: np.ndarray, steps: list[int], level: int) -> np.ndarray:
    """Of each start of a full window: where its window of length ``steps[level]`` starts."""
    window, starts = steps[-1], max(len(first_hashes) + steps[0] - steps[-1], 0)
    begin, own = sampled_places(first_hashes, window - steps[0] + 1), np.arange(starts)
    for short, long in zip(steps[:level], steps[1 : level + 1], strict=True):
        begin = np.where(begin - own + long <= window, begin, begin - (long - short))
    return begin
