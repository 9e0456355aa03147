"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A position's rank is the class of the string of the present length that starts there; the rank at
twice the length is that of the pair of ranks at the position and at the offset. Ranks are hashes, so that a task
knows them without a shuffle, and what Spark sorts are (rank, document) pairs: those
of ranks that are unique to one document drop out after each length, the others are
doubled, up to the window. Positions are sampled (see ``levels``): every full window
is followed through one position, and equal windows through equal ranks. In the last step the windows around the
positions of a rank are sorted by the pair of their halves' ranks, which tells which of
them a smaller document has had. Full windows are compared by 128 hashed bits, ranks
before by 47 (a false match there only lets a candidate pass). Copies of whole texts
are removed as wholes.

A rank that very many documents have isn't brought together: its positions are told apart by their whole
surroundings first, and only one of each kind, that of the smallest document, is taken apart into windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .levels import followed, lengths
from .scratch import materialize
from .substrings import copies_of, lists, member_of, text_of, within

#: Text that a task samples before it sends the ranks on, in bytes.
GATHER = 8 << 20
#: A rank is hot if so many documents of ``GATHER`` bytes of text have it, or if that leaves more than ``HOT`` pairs of it.
MANY_HERE, HOT = 64, 20_000
#: Bits of a rank; marks of ranks that many documents of a pack have, and of hot ones.
RANK, MARK, HOT_BIT = np.uint64((1 << 47) - 1), np.uint64(1 << 47), np.uint64(1 << 62)
_BYTES = np.random.default_rng(5077).integers(0, 2**64, (2, 256), dtype=np.uint64)


def _ranks(data: np.ndarray, steps: list[int], level: int) -> np.ndarray:
    """Of each start of a full window: the 47-bit rank at length ``steps[level]`` of the position that it is followed through."""
    first = tk.byte_windows(data, steps[0], _BYTES[0])
    if level == 0:
        return tk.sliding(first, steps[-1] - steps[0] + 1, True) >> np.uint64(17)
    return tk.byte_windows(data, steps[level], _BYTES[0])[followed(first, steps, level)] >> np.uint64(17)


def _alive(off: np.ndarray, data: np.ndarray, steps: list[int], level: int, live: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of full windows whose rank at ``level`` is among ``live``, all if there is none; their ranks, their texts)."""
    starts = np.nonzero(within(off, steps[-1]))[0]
    rank, text = _ranks(data, steps, level)[starts] if len(starts) else np.zeros(0, np.uint64), text_of(off)[starts]
    if live is not None:
        hit = member_of(rank, text, *live)
        starts, rank, text = starts[hit], rank[hit], text[hit]
    return starts, rank, text


def _doubled(data: np.ndarray, window: int, which: int) -> np.ndarray:
    """Rank of each ``window``-byte string as that of the pair of its halves' ranks, which overlap if it is odd."""
    half = -(-window // 2)
    h = tk.byte_windows(data, half, _BYTES[which])
    return tk.pair_hash(h[: len(h) - (window - half)], h[window - half :], which)


def _pack(parts: int, steps: list[int], level: int, many_here: int):
    """(doc_id, text, live of the length before) -> (bucket, ranks, docs, counts): sampled ranks, six bytes each, packed by bucket.

    A rank that ``many_here`` documents of a pack have is known to be repeated: its pairs go to a bucket that
    needs no comparison, numbered from ``parts`` on, and only those of its smallest and greatest document, marked by the highest bit, to its own.
    """

    def row_of(bucket: int, rank: np.ndarray, doc: np.ndarray) -> tuple:
        first = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0]
        six = rank.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        return bucket, six, doc[first].tobytes(), np.diff(np.append(first, len(doc))).astype(np.uint32).tobytes()

    def packed(ranks: list[np.ndarray], docs: list[np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
        rank, doc, rows = np.concatenate(ranks), np.concatenate(docs), []
        order = np.argsort(rank)
        first = np.nonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))[0]
        size = np.diff(np.append(first, len(rank)))
        if (size >= many_here).any():
            many = np.zeros(len(rank), bool)
            many[order] = np.repeat(size >= many_here, size)
            rows.append(row_of(parts + salt % parts, rank[many], doc[many]))
            ends = [f.reduceat(doc[order], first)[size >= many_here] for f in (np.minimum, np.maximum)]
            own = rank[order][first][size >= many_here] | MARK
            rank, doc = np.concatenate([rank[~many], own, own]), np.concatenate([doc[~many], *ends])
        bucket = (tk.mix(rank & RANK, 3) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank, doc, bucket = rank[order], doc[order], bucket[order]
        at = np.searchsorted(bucket, np.arange(parts + 1))
        rows += [row_of(int(b), rank[at[b] : at[b + 1]], doc[at[b] : at[b + 1]]) for b in np.nonzero(np.diff(at))[0]]
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "ranks", "docs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, docs, held, salt = [], [], 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for row, off, data in tk.blocks(batch.column(1)):
                live = _live(batch.column(2).slice(row, len(off) - 1))[0] if level else None
                at, rank, text = _alive(off, data, steps, max(level - 1, 0), live)
                if level and len(at):
                    rank = _ranks(data, steps, level)[at]
                new = np.ones(len(rank), bool)
                new[1:] = (rank[1:] != rank[:-1]) | (text[1:] != text[:-1])
                ranks.append(rank[new])
                docs.append(ids[row + text[new]])
                held += len(data)
                if held >= GATHER and sum(map(len, ranks)):
                    yield from packed(ranks, docs, salt)
                    ranks, docs, held, salt = [], [], 0, salt + 1
        if sum(map(len, ranks)):
            yield from packed(ranks, docs, salt)

    return run


def _live(column: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(all, hot) live ranks of a list column, each as (rank, row)."""
    values, row = lists(column)
    hot = values >= HOT_BIT
    return (values & RANK, row), (values[hot] & RANK, row[hot])


def _repeated(parts: int, hot_from: int):
    """Packed ranks of whole buckets, bucket by bucket -> (doc_id, rank) of ranks in two documents and more, with ``HOT_BIT`` if in very many."""

    def unique_out(bucket: int, rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        six = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, 6)
        rank = np.zeros((len(six), 8), np.uint8)
        rank[:, :6] = six
        rank = rank.view(np.uint64).ravel()
        doc = np.repeat(np.frombuffer(b"".join(r[1] for r in rows), np.int64), np.frombuffer(b"".join(r[2] for r in rows), np.uint32))
        if bucket >= parts:
            return pa.RecordBatch.from_arrays([pa.array(doc), tk.long_array(rank | HOT_BIT)], names=["doc_id", "rank"])
        order = np.argsort(rank & RANK)
        rank, doc = rank[order], doc[order]
        plain = rank & RANK
        first = np.nonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))[0]
        size = np.diff(np.append(first, len(rank)))
        hot = np.repeat((np.maximum.reduceat(rank, first) >= MARK) | (size > hot_from), size)
        keep = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), size)
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), tk.long_array(np.where(hot, plain | HOT_BIT, plain)[keep])], names=["doc_id", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (bucket != now or now >= parts):
                    yield unique_out(now, rows)
                    rows = []
                now = bucket
                rows.append(row)
        if rows:
            yield unique_out(now, rows)

    return run


def _contexts(steps: list[int], hot: bool):
    """(doc_id, version, text, live) -> (rank, a, b, doc_id, version, start, around): windows in a row of one live rank, and their bytes.

    Those of hot ranks, or those of all others, which need no (a, b): 128 bits of their bytes, of which two windows hold all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for row, off, data in tk.blocks(batch.column(2)):
                every, among = _live(batch.column(3).slice(row, len(off) - 1))
                at, rank, text = _alive(off, data, steps, len(steps) - 2, among if hot else every)
                if not hot and len(among[0]):
                    cold = ~member_of(rank, text, *among)
                    at, rank, text = at[cold], rank[cold], text[cold]
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (rank[1:] != rank[:-1]) | (text[1:] != text[:-1])
                first, last = at[new], at[np.append(np.nonzero(new)[0][1:], len(at)) - 1]
                size = last + steps[-1] - first
                upto = np.concatenate([[0], np.cumsum(size)])
                flat = data[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
                around = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                keys = []
                for i in (0, 1) if hot else ():
                    h = _doubled(data, steps[-1], i)
                    keys.append(tk.long_array(tk.pair_hash(h[first], h[last] ^ size.astype(np.uint64), 17 + i)))
                of = text[new]
                keys = keys or [tk.long_array(rank[new])]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(ids[row + of]), pa.array(versions[row + of]), pa.array(first - off[of]), around], names=[*(["a", "b"] if hot else ["rank"]), "doc_id", "version", "start", "around"])

    return run


#: Hot strings of one bucket go to so many tasks, each with the bucket's minima.
SALTS = 8
_PACKED = "bucket int, salt int, x binary, y binary, a binary, b binary, docs binary, ats binary"


def _packs(columns: list[np.ndarray], bucket: np.ndarray, names: list[str], **more: int) -> Iterator[pa.RecordBatch]:
    """One batch with a row for each bucket, whose columns hold the numbers of all its entries."""
    order = np.argsort(bucket, kind="stable")
    kinds, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(order))
    if len(kinds):
        packed = [pa.array([c[order[i:j]].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), *[pa.array(np.full(len(kinds), v), pa.int32()) for v in more.values()], *packed], names=["bucket", *more, *names])


def _unpacked(cells: list[bytes], kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind)


def _buckets(batches: Iterator[pa.RecordBatch], by: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """(first ``by`` columns, rows) of each run of rows that agree in these."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:by] != now:
                yield now, rows
                rows = []
            now = row[:by]
            rows.append(row[by:])
    if rows:
        yield now, rows


def _hot_strings(parts: int, window: int):
    """(a, b, doc_id, around) -> each full window of a context by 128 bits, in packs by bucket of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, held, size = TaskContext.get().partitionId(), [], 0
        done = lambda: _packs([np.concatenate(c) for c in zip(*held, strict=True)], np.concatenate([h[0] for h in held]).view(np.uint64) % np.uint64(parts), ["x", "y", "a", "b", "docs", "ats"], salt=salt % SALTS)
        for batch in batches:
            a, b, doc = (np.asarray(batch.column(i)) for i in range(3))
            for row, off, data in tk.blocks(batch.column(3)):
                at = np.nonzero(within(off, window))[0]
                of = text_of(off)[at]
                x, y = (_doubled(data, window, i)[at].view(np.int64) for i in (0, 1))
                held.append((x, y, a[row + of], b[row + of], doc[row + of], (at - off[of]).astype(np.int64)))
                size += len(data)
                if size >= GATHER // 4:
                    yield from done()
                    held, size, salt = [], 0, salt + 1
        if held:
            yield from done()

    return run


def _ends_of(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (x, y) in order, with the least and greatest document of each."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.nonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))[0] if len(x) else np.zeros(0, np.int64)
    return (x[first], y[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)) if len(x) else (x, y, low, high)


def _string_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, x, y, docs) -> (bucket, x, y, low, high), each string once in a row."""
    for batch in batches:
        rows = []
        for bucket, x, y, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            doc = np.frombuffer(docs, np.int64)
            rows.append((bucket, *(v.tobytes() for v in _ends_of(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), doc, doc))))
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "x", "y", "low", "high"])


def _repeated_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole buckets -> (bucket, salt, x, y, low as docs) of strings in two documents and more, for each salt."""
    for (bucket,), rows in _buckets(batches):
        x, y, low, high = _ends_of(*(_unpacked([r[i] for r in rows]) for i in range(4)))
        x, y, low = (v[low < high].tobytes() for v in (x, y, low))
        none = pa.nulls(SALTS, pa.binary())
        same = lambda v: pa.array([v] * SALTS, pa.binary())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * SALTS, pa.int32()), pa.array(range(SALTS), pa.int32()), same(x), same(y), none, none, same(low), none], names=["bucket", "salt", "x", "y", "a", "b", "docs", "ats"])


def _lost_strings(parts: int):
    """Minima of a bucket and salt, then its strings pack by pack -> (a, b, at) of strings that a smaller document has, in packs by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            for row in batch.to_pylist():
                x, y, doc = (np.frombuffer(row[c], np.int64) for c in ("x", "y", "docs"))
                if row["ats"] is None:
                    known = (row["bucket"], row["salt"]), x, y, doc
                    continue
                if known is None or known[0] != (row["bucket"], row["salt"]) or not len(known[1]):
                    continue
                _, kx, ky, low = known
                at = np.searchsorted(kx, x)
                last = len(kx) - 1
                at = np.minimum(at, last)
                while (more := (kx[at] == x) & (ky[at] < y) & (at < last) & (kx[np.minimum(at + 1, last)] == x)).any():  # strings that agree in the first 64 bits
                    at = at + more
                gone = (kx[at] == x) & (ky[at] == y) & (doc > low[at])
                a, b, place = (np.frombuffer(row[c], np.int64)[gone] for c in ("a", "b", "ats"))
                yield from _packs([a, b, place], a.view(np.uint64) % np.uint64(parts), ["a", "b", "ats"])

    return run


def _by_context(window: int):
    """Packs of whole buckets of contexts -> (a, b, starts, stops): the bytes of each context that its lost strings cover, overlapping ones as one span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _buckets(batches):
            a, b, at = (_unpacked([r[i] for r in rows]) for i in range(3))
            order = np.lexsort((at, b, a))
            a, b, at = a[order], b[order], at[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            begins = np.nonzero(new | np.concatenate([[True], at[1:] > at[:-1] + window]))[0]
            last = np.append(begins[1:], len(at)) - 1
            first = np.nonzero(new)[0]
            offsets = pa.array(np.append(np.searchsorted(begins, first), len(begins)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.ListArray.from_arrays(offsets, pa.array(at[begins])), pa.ListArray.from_arrays(offsets, pa.array(at[last] + window))], names=["a", "b", "starts", "stops"])

    return run


def _hot_spans(contexts: DataFrame, window: int) -> DataFrame:
    """Contexts (a, b, doc_id, version, start, around) -> (doc_id, starts, stops, versions): for each document the spans of strings that a smaller one has.

    All documents with a context but the smallest lose it whole; for that one, the strings of different contexts are compared. Strings
    aren't rows: they are shuffled in packs by bucket, least and greatest documents of each pack's strings first, which give the minima of the repeated ones, then the packs
    themselves, each to one of ``SALTS`` tasks of its bucket with these minima, so that a string in all contexts isn't one task's. What they lose goes back by context.
    """
    spark = contexts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = materialize(contexts.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.min("around").alias("around")), "hot-kinds")
    strings = materialize(kinds.mapInArrow(_hot_strings(parts, window), _PACKED), "hot-strings")
    ends = strings.select("bucket", "x", "y", "docs").mapInArrow(_string_ends, "bucket int, x binary, y binary, low binary, high binary")
    least = ends.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated_strings, _PACKED)
    dealt = least.unionByName(strings).repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("ats").isNotNull())
    lost = dealt.mapInArrow(_lost_strings(parts), "bucket int, a binary, b binary, ats binary")
    again = lost.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_context(window), "a long, b long, starts array<long>, stops array<long>")
    known = materialize(kinds.select("a", "b", F.col("doc_id").alias("smallest")).join(again, ["a", "b"], "left"), "hot-known")
    none, moved = F.array().cast("array<long>"), lambda c: F.transform(F.coalesce(c, F.array().cast("array<long>")), lambda at: F.col("start") + at)
    whole = F.col("doc_id") > F.col("smallest")
    told = contexts.join(known, ["a", "b"]).select(
        "doc_id", "version", F.when(whole, F.array("start")).otherwise(moved("starts")).alias("starts"), F.when(whole, F.array(F.col("start") + F.octet_length("around"))).otherwise(moved("stops")).alias("stops")
    )
    told = told.withColumn("versions", F.transform("starts", lambda _: F.col("version")))
    return told.groupBy("doc_id").agg(*[F.coalesce(F.flatten(F.collect_list(c)), none).alias(c) for c in ("starts", "stops", "versions")])


def _spans(window: int):
    """Contexts sorted by (rank, doc_id) -> (doc_id, version, start, stop) of strings that a smaller document has.

    What is kept between batches are the distinct strings of the rank at hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        held_rank = None
        for whole in batches:
            for cut in range(0, whole.num_rows, 8192):
                batch = whole.slice(cut, 8192)
                rank, ids, version, start = (np.asarray(batch.column(i)) for i in range(4))
                column = batch.column(4)
                off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
                off -= off[0]
                ok = within(off, window)
                at = np.nonzero(ok)[0]
                row = text_of(off)[at]
                a, b = (_doubled(data, window, i)[at] for i in (0, 1))
                doc = ids[row]
                n = len(held[0]) if held_rank == rank[0] else 0
                a_, b_, doc_ = (np.concatenate([h[:n], x]) for h, x in zip(held, (a, b, doc), strict=True))
                order = np.argsort(a_)
                sa, sb = a_[order], b_[order]
                if ((sa[1:] == sa[:-1]) & (sb[1:] != sb[:-1])).any():  # the first 64 bits don't tell all strings apart
                    order = np.lexsort((b_, a_))
                    sa, sb = a_[order], b_[order]
                first = np.nonzero(np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])]))[0]
                if not len(order):
                    continue
                least = np.minimum.reduceat(doc_[order], first)
                gone = np.zeros(len(a_), bool)
                gone[order] = np.repeat(least, np.diff(np.append(first, len(order)))) < doc_[order]
                ranks = np.concatenate([np.full(n, rank[0]), rank[row]])
                mine = ranks[order][first] == rank[-1]
                held, held_rank = [sa[first][mine], sb[first][mine], least[mine]], rank[-1]
                hit = gone[n:]
                p, r = (start[row] + at - off[row])[hit], row[hit]
                if len(p):
                    new = np.ones(len(p), bool)
                    new[1:] = (p[1:] != p[:-1] + 1) | (r[1:] != r[:-1])
                    ends = np.append(np.nonzero(new)[0][1:], len(p)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r[new]]), pa.array(version[r[new]]), pa.array(p[new]), pa.array(p[ends] + window)], names=["doc_id", "version", "start", "stop"])

    return run


def _cut(window: int, with_text: bool):
    """(doc_id, version, text, spans of all versions as starts, stops, versions, copies) -> what is removed and what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = batch.column(6).to_pylist()
            version = np.asarray(batch.column(1).fill_null(0)).view(np.uint64)
            for row, off, data in tk.blocks(batch.column(2)):
                n = len(off) - 1
                cover = np.zeros(len(data) + 1, np.int32)
                of, text = lists(batch.column(5).slice(row, n))
                own = of == version[row + text]
                for column, step in ((3, 1), (4, -1)):
                    at = lists(batch.column(column).slice(row, n))[0][own]
                    np.add.at(cover, at.view(np.int64) + off[text[own]], step)
                keep = np.cumsum(cover[:-1]) == 0
                for i in range(n):
                    if copies[row + i] and off[i + 1] - off[i] >= window and hashlib.md5(data[off[i] : off[i + 1]]).hexdigest() in copies[row + i]:
                        keep[off[i] : off[i + 1]] = False
                gone = ~keep
                begins = gone.copy()
                begins[1:] &= keep[:-1]
                begins[off[:-1][off[:-1] < len(data)]] = gone[off[:-1][off[:-1] < len(data)]]
                count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])  # noqa: B023, E731
                kept = [data[off[i] : off[i + 1]][keep[off[i] : off[i + 1]]].tobytes() for i in range(n)]
                columns = [batch.column(0).slice(row, n), pa.array(np.diff(off)), pa.array(count(gone)), pa.array(count(begins)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                columns.append(pa.array(kept if with_text else [None] * n, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = 50, with_text: bool = True, first: int = 25, hot_from: int = HOT, survivors: dict[int, int] | None = None) -> DataFrame:
    """Remove bytes covered by a ``window``-byte string that also starts in a smaller doc_id.

    Texts are whole, as UTF-8; strings lie in one document and are judged on the input.
    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): maximal removed runs and
    the remaining bytes (null unless ``with_text``; a cut may split a character). Null and empty
    texts have no bytes; very long ones are handled one at a time, in some ten arrays of eight bytes for each byte. Rows that repeat a doc_id
    are versions of one document: they don't remove each other's bytes, and each loses what a smaller doc_id
    has; rows without doc_id lose nothing. Other columns are ignored; an empty table gives an empty result.
    ``first``: bytes of the first length at least; a rank with more than ``hot_from`` pairs is hot (neither
    changes the results). ``survivors`` is filled with the number of (rank, document) pairs found repeated at each length.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = lengths(window, min(max(first, 2), -(-window // 2)))
    docs = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    known = docs.where("doc_id IS NOT NULL")
    copies = copies_of(known)
    live = None
    for level, length in enumerate(steps[:-1]):
        # one exchange of the texts by doc_id serves all joins but those of levels that were written before
        asked = known.select("doc_id", "text") if live is None else known.join(live, "doc_id").select("doc_id", "text", "live")
        packed = asked.mapInArrow(_pack(parts, steps, level, MANY_HERE), "bucket int, ranks binary, docs binary, counts binary")
        shared = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated(parts, hot_from), "doc_id long, rank long")
        if live is None:
            shared = shared.join(copies.where("wholly").select("doc_id"), "doc_id", "left_anti")
        live = materialize(shared.groupBy("doc_id").agg(F.collect_set("rank").alias("live")), f"live-ranks-{length}")
        if survivors is not None:
            survivors[length] = live.agg(F.sum(F.size("live")).alias("n")).first()["n"] or 0
        if live.isEmpty():
            break
    columns = "doc_id long, version long, start long, around binary"
    judged = lambda live: known.join(live, "doc_id").select("doc_id", "version", "text", "live")
    around = judged(live).mapInArrow(_contexts(steps, False), f"rank long, {columns}")
    spans = around.repartition(parts, "rank").sortWithinPartitions("rank", "doc_id").mapInArrow(_spans(window), "doc_id long, version long, start long, stop long")
    spans = spans.groupBy("doc_id").agg(*[F.collect_list(F.col(c)).alias(f"{c}s") for c in ("start", "stop", "version")])
    hot = live.where(F.exists("live", lambda r: r >= int(HOT_BIT)))
    if not hot.isEmpty():
        contexts = materialize(judged(hot).mapInArrow(_contexts(steps, True), f"a long, b long, {columns}"), "hot-contexts")
        both = spans.unionByName(_hot_spans(contexts, window))
        spans = both.groupBy("doc_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops", "versions")])
    judged = known.join(spans.join(copies.select("doc_id", "copies"), "doc_id", "full_outer"), "doc_id", "left").select("doc_id", "version", "text", "starts", "stops", "versions", "copies")
    none = F.lit(None).cast("array<long>")
    nameless = docs.where("doc_id IS NULL").select("doc_id", "version", "text", *[none.alias(c) for c in ("starts", "stops", "versions")], F.lit(None).cast("array<string>").alias("copies"))
    return judged.unionByName(nameless).mapInArrow(_cut(window, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
