"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a block (a run of spaces and what follows up to the next) are
laid one after another and indexed by a suffix array (its parts hold ``SORTED`` suffixes each); binary search finds the range of
occurrences of every piece, which gives an edge for each occurrence, sorted by position.
The edges are then relaxed in the order of a BPE model: of the edges that join two
neighbouring symbols, each segment takes the one of highest score, the leftmost of equals, until none is
left. (A best sum of scores, as for a unigram model, would not give a BPE model's ids.)
Characters in no piece become byte pieces.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .segments import SegmentEncoder

SPACE = "▁".encode()
#: Bytes that no UTF-8 text has: between segments, and above all text in searches.
GAP, TOP = b"\xfe", b"\xff"
#: Segments of more bytes are relaxed one by one.
LONG = 256
#: Suffixes sorted at once; a block with more is indexed in parts, each of which finds the edges that start in it.
SORTED = 1 << 18
_models: dict[str, "PieceModel"] = {}


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte pieces and without normalisation are handled")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        raw = [p.piece.encode() for p in model.pieces]
        self.byte_id = np.zeros(256, np.int32)
        out = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
            out.append(bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else raw[i].replace(SPACE, b" ") if p.type == 1 else b"")
        self.out_start = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        normal = sorted((raw[i], i) for i, p in enumerate(model.pieces) if p.type == 1)
        if any(SPACE in _strip(x) for x, _ in normal):
            raise ValueError("a piece has a space after another character")
        self.piece_bytes = [x for x, _ in normal]
        self.piece_id = np.array([i for _, i in normal], np.int32)
        self.piece_size = np.array([len(x) for x in self.piece_bytes])
        self.score = np.array([model.pieces[i].score for i in self.piece_id])
        self.width = int(self.piece_size.max())
        self.low = np.array(self.piece_bytes, f"S{self.width}")
        self.high = np.array([x + TOP for x in self.piece_bytes], f"S{self.width + 1}")
        self.encoder = SegmentEncoder(self.encode_segments, _run_cuts)

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, number of piece) of every occurrence of a piece, sorted by position."""
        padded = np.concatenate([data, np.full(self.width, GAP[0], np.uint8)])
        every, found = np.nonzero((data & 0xC0) != 0x80)[0], []
        for part in range(0, len(every), SORTED):
            starts = every[part : part + SORTED]
            suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width)[starts]).view(f"S{self.width}").ravel()
            order = np.argsort(suffixes, kind="stable")
            ranked = suffixes[order]
            first, last = np.searchsorted(ranked, self.low), np.searchsorted(ranked, self.high)
            n = last - first
            piece = np.repeat(np.arange(len(n)), n)
            upto = np.cumsum(n)
            at = starts[order[np.arange(upto[-1]) - np.repeat(upto - n, n) + np.repeat(first, n)]]
            by = np.lexsort((self.piece_size[piece], at))
            found.append((at[by], piece[by]))
        at, piece = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        return at, at + self.piece_size[piece], piece

    def encode_segments(self, segments: list[bytes]) -> list[np.ndarray]:
        marked = [s.replace(b" ", SPACE) for s in segments]
        data = np.frombuffer(GAP.join(marked) + GAP, np.uint8)
        size = np.array([len(s) for s in marked])
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        start, end, piece = self.edges(data)
        bound = ((data & 0xC0) != 0x80).copy()
        owner = np.searchsorted(begin, start, "right") - 1
        long = size > LONG
        for s in np.nonzero(long)[0]:
            self._relax_one(bound, *(x[slice(*np.searchsorted(owner, [s, s + 1]))] for x in (start, end, piece)))
        live = ~long[owner] & (end - start > 1)
        s, e, p, o = start[live], end[live], piece[live], owner[live]
        rank = np.lexsort((s, -self.score[p]))
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        while len(s):
            inside = np.cumsum(bound)
            # still possible: both ends bound symbols; joins now: one bound between them
            open_ = bound[s] & bound[e] & (inside[e - 1] - inside[s] >= 1)
            s, e, p, o, place = s[open_], e[open_], p[open_], o[open_], place[open_]
            now = np.nonzero(inside[e - 1] - inside[s] == 1)[0]
            if not len(now):
                break
            best = now[np.lexsort((place[now], o[now]))]
            best = best[np.concatenate([[True], o[best][1:] != o[best][:-1]])]
            # the segment's best edge loses its inner bound
            for_all = np.repeat(s[best] + 1, e[best] - s[best] - 1)
            step = np.arange(len(for_all)) - np.repeat(np.cumsum(e[best] - s[best] - 1) - (e[best] - s[best] - 1), e[best] - s[best] - 1)
            bound[for_all + step] = False
            busy = np.zeros(len(size), bool)
            busy[o[best]] = True
            keep = busy[o]
            s, e, p, o, place = s[keep], e[keep], p[keep], o[keep], place[keep]
        return self._ids(data, bound, start, end, piece, begin, size)

    def _relax_one(self, bound: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> None:
        """The same on a long segment, with a heap of the edges that join neighbours; symbols and edges are kept in flat arrays."""
        if not len(start):
            return
        lo, hi = int(start.min()), int(end.max())
        base = hi + 1
        edges, score = array("q", (start * base + end).tobytes()), self.score[piece]  # ascending: by start, then by length
        at = lo + np.nonzero(bound[lo:hi])[0]
        after, before = array("q", bytes(8 * (hi - lo + 1))), array("q", bytes(8 * (hi - lo + 1)))  # 0: no symbol starts here (lo counts from 1)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), hi], strict=True):
            after[a - lo], before[b - lo] = b - lo + 1, a - lo + 1
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a] - 1
            c = after[b] - 1 if b < hi - lo else -1
            if c > 0:
                key = (a + lo) * base + c + lo
                place = bisect_left(edges, key)
                if place < len(edges) and edges[place] == key:
                    heapq.heappush(heap, (-score[place], a, b, c))

        for a in (at - lo).tolist():
            offer(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if after[a] == b + 1 and after[b] == c + 1:
                bound[b + lo] = False
                after[b] = 0
                after[a], before[c] = c + 1, a + 1
                if before[a]:
                    offer(before[a] - 1)
                offer(a)

    def _ids(self, data, bound, start, end, piece, begin, size) -> list[np.ndarray]:
        s = np.nonzero(bound & (data != GAP[0]))[0]
        stops = np.nonzero(bound)[0]
        e = stops[np.searchsorted(stops, s, "right")]
        key, asked = start * (len(data) + 1) + end, s * (len(data) + 1) + e
        order = np.argsort(key)
        place = np.minimum(np.searchsorted(key[order], asked), max(len(key) - 1, 0))
        found = key[order][place] == asked if len(key) else np.zeros(len(s), bool)
        n = np.where(found, 1, e - s)
        upto = np.concatenate([[0], np.cumsum(n)])
        within = np.arange(upto[-1]) - np.repeat(upto[:-1], n)
        ids = self.byte_id[data[np.repeat(s, n) + within]]
        ids[upto[:-1][found]] = self.piece_id[piece[order[place[found]]]]
        cut = upto[np.searchsorted(s, begin[:-1])]
        return [ids[a:b] for a, b in zip(cut, [*cut[1:], len(ids)], strict=True)]

    def encode(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and of the end) of a block."""
        if self.prefix:  # one space before each text that isn't empty
            size = np.diff(off)
            has = (size > 0).astype(np.int64)
            moved = off + np.concatenate([[0], np.cumsum(has)])
            out = np.full(len(data) + has.sum(), 32, np.uint8)
            out[np.arange(len(data)) + np.repeat(np.cumsum(has), size)] = data
            off, data = moved, out
        return self.encoder.block(off, data)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, first byte of each text and of the end) of a block's ids."""
        size = (self.out_start[1:] - self.out_start[:-1])[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        out = self.out_bytes[np.repeat(self.out_start[:-1][ids] - upto[:-1], size) + np.arange(upto[-1])]
        at = upto[first]
        if self.prefix:
            lead = at[:-1][np.diff(at) > 0]
            keep = np.ones(len(out), bool)
            keep[lead] = False
            at = np.concatenate([[0], np.cumsum(keep)])[at]
            out = out[keep]
        return out, at


def _strip(x: bytes) -> bytes:
    while x.startswith(SPACE):
        x = x[len(SPACE) :]
    return x


def _run_cuts(data: np.ndarray) -> np.ndarray:
    """Before a space that follows no space (U+2581 counts as one, so nothing is cut after it)."""
    edge = np.zeros(len(data), bool)
    mark = np.frombuffer(SPACE, np.uint8)
    after = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        after[3:] = (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
    edge[1:] = (data[1:] == 32) & (data[:-1] != 32) & ~after[1:-1]
    return edge


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _coded(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for row, off, data in tk.blocks(batch.column(1)):
                n = len(off) - 1
                ids, first = model.encode(off, data)
                back, at = model.decode(ids, first)
                own = [ids[first[i] : first[i + 1]] for i in range(n)]
                same = [np.array_equal(back[at[i] : at[i + 1]], data[off[i] : off[i + 1]]) for i in range(n)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in own]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)) if with_ids else pa.array([None] * n, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(np.diff(first)), pa.array(crc, pa.int64()), pa.array([zlib.crc32(back[at[i] : at[i + 1]].tobytes()) for i in range(n)], pa.int64()), pa.array(same), lists],
                    names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip", "ids"],
                )

    return run


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """Encode whole texts with a SentencePiece BPE model and decode them again, without a shuffle.

    ``model``: path of the model on all machines. Returns (doc_id, n_ids, ids_crc32, decoded_crc32, round_trip,
    ids), a row for each row of ``docs``: ids_crc32 of the ids as little-endian unsigned
    32-bit integers; round_trip: the decoded text is the text (false only if it has U+2581,
    which the model reads as a space); ids are null unless ``with_ids``. Null and empty texts have no ids. A very long text
    without spaces is one segment; its edges take some 30 bytes each, about as many as its bytes.
    Repeated and null doc_ids are kept as they are; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_coded(model, with_ids), "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean, ids array<int>")
