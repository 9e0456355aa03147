"""Encode texts through their distinct segments, which are cached in each Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textkit as tk

#: Cached segments of a worker, of some 50 bytes each; beyond it the cache starts anew (results are the same).
CACHE = 500_000


class SegmentEncoder:
    """Ids of texts whose encoding is that of their segments, one after another.

    ``encode``: ids of each of a list of byte strings. ``cuts``: where segments start in
    a block, besides the starts of texts.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], cuts: Callable[[np.ndarray], np.ndarray]):
        self.encode, self.cuts = encode, cuts
        self._clear()

    def _clear(self) -> None:
        # known segments: their hashes in ascending order with their numbers, and by number their bytes and ids
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.raw, self.raw_at, self.ids, self.at = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known segments by their hashes, -1 of unknown ones."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.numbers[place], -1)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        found = self.encode(pieces)
        numbers = np.arange(len(self.numbers), len(self.numbers) + len(pieces), dtype=np.int32)
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")  # two ascending runs, which this merges
        self.hashes, self.numbers = both[order], np.concatenate([self.numbers, numbers])[order]
        self.raw, self.ids = np.concatenate([self.raw, np.frombuffer(b"".join(pieces), np.uint8)]), np.concatenate([self.ids, *found])
        for name, sizes in (("raw_at", map(len, pieces)), ("at", map(len, found))):
            known = getattr(self, name)
            setattr(self, name, np.concatenate([known, known[-1] + np.cumsum(np.fromiter(sizes, np.int64, len(pieces)))]))

    def block(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, first id of each text and of the end).

        Segments are looked up by a hash, but all are compared with the known one byte by byte: one that
        differs from it is encoded by itself.
        """
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        if len(self.hashes) > CACHE:
            self._clear()
        edge = self.cuts(data)
        edge[off[off < len(data)]] = True
        starts = np.nonzero(edge)[0]
        ends = np.concatenate([starts[1:], [len(data)]])
        kinds, one, which = np.unique(tk.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        new, raw = np.nonzero(self._numbers(kinds) < 0)[0], data.tobytes()
        if len(new):
            self._learn(kinds[new], [raw[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
        number = self._numbers(kinds)[which]
        start, size = self.at[number], self.at[number + 1] - self.at[number]
        bytes_of = self.raw_at[number + 1] - self.raw_at[number]
        same = bytes_of == ends - starts
        same[same] = tk.same_bytes(data, starts[same], self.raw, self.raw_at[number[same]], bytes_of[same])
        ids = self.ids
        if len(odd := np.nonzero(~same)[0]):
            found = self.encode([raw[starts[i] : ends[i]] for i in odd])
            size[odd] = [len(x) for x in found]
            start[odd] = len(ids) + np.cumsum(size[odd]) - size[odd]
            ids = np.concatenate([ids, *found])
        upto = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start - upto[:-1], size) + np.arange(upto[-1])
        return ids[take], upto[np.searchsorted(starts, off)]
