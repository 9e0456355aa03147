"""Periodic runs of words: a harmonic grid of probes, and stretches that grow from those that hit.

A run with period p and at least 2p words has p places or more, one after another, whose word comes again p words later.
One of them is a multiple of p. So it is enough to ask at the places 0, p, 2p, ... of a text whether the word there is the word p
later; over all periods these are n + n/2 + n/3 + ... questions. What answers yes is extended to both sides in chunks
that double, up to the next places of the grid, and neighbours that meet are one stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk

#: Probes, and words of a chunk over all stretches, that are looked at together.
PROBES, CHUNK = 1 << 20, 1 << 20
SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, "
    "runs_sha256 string, n_kept long, collapsed_sha256 string, collapsed string"
)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 of each size, one after another."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - sizes, sizes)


def _equal_for(codes: np.ndarray, at: np.ndarray, period: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many places from ``at`` on, in direction ``step``, have the word that comes ``period`` later; at most ``limit``."""
    found, live, width = np.zeros(len(at), np.int64), np.nonzero(limit > 0)[0], 4
    while len(live):
        rest = []
        for some in np.array_split(live, -(-len(live) * width // CHUNK)):
            there = (at[some] + step * found[some])[:, None] + step * np.arange(width)
            inside = np.arange(width) < (limit[some] - found[some])[:, None]
            there = np.where(inside, there, at[some][:, None])
            same = (codes[there] == codes[there + period[some][:, None]]) & inside
            more = np.where(same.all(1), width, np.argmin(same, 1))
            found[some] += more
            rest.append(some[(more == width) & (found[some] < limit[some])])
        live, width = np.concatenate(rest), min(2 * width, CHUNK)
    return found


def _stretches(codes: np.ndarray, first: np.ndarray, doc: np.ndarray, period: np.ndarray, skip: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(doc, start, length, period) of the runs of some (document, period) pairs; ``skip``: sorted keys of probes within known runs."""
    begin, end = first[doc], first[doc + 1]
    probes = (end - begin - 1) // period
    which = np.repeat(np.arange(len(doc)), probes)
    at = begin[which] + _ranges(probes) * period[which]
    hit = np.nonzero(codes[at] == codes[at + period[which]])[0]
    which, at = which[hit], at[hit]
    if len(skip) and len(at):
        keys = period[which] * np.int64(len(codes) + 1) + at
        known = skip[np.minimum(np.searchsorted(skip, keys), len(skip) - 1)] == keys
        which, at = which[~known], at[~known]
    p = period[which]
    ahead = _equal_for(codes, at, p, np.minimum(p, end[which] - p - at), 1)
    behind = _equal_for(codes, at - 1, p, np.minimum(p - 1, at - begin[which]), -1)
    # a stretch goes on to the next probe if all places up to it are equal and it is a hit as well
    joined = np.zeros(len(at), bool)
    joined[1:] = (which[1:] == which[:-1]) & (at[1:] == at[:-1] + p[:-1]) & (ahead[:-1] == p[:-1])
    heads = np.nonzero(~joined)[0]
    tails = np.append(heads[1:], len(at)) - 1 if len(heads) else heads
    start, stop = at[heads] - behind[heads], at[tails] + ahead[tails]
    p, length = p[heads], stop - start + p[heads]
    long = np.nonzero(length >= np.maximum(least, 2 * p))[0]
    return doc[which[heads[long]]], start[long], length[long], p[long]


def find_runs(codes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(document, start in ``codes``, length, smallest period) of all runs; document d has the codes from ``first[d]`` to ``first[d + 1]``.

    Periods are taken from p to 2p - 1 together: none of them divides another. A stretch whose smallest period q is smaller lies
    within the run of q, which was found before, and so do its probes: they are passed over.
    """
    sizes, low = np.diff(first), 1
    docs = np.nonzero(sizes >= 2)[0]
    found: list[tuple[np.ndarray, ...]] = []
    while len(docs := docs[sizes[docs] >= 2 * low]):
        skip = np.zeros(0, np.int64)
        if found:
            _, start, length, q = (np.concatenate(x) for x in zip(*found, strict=True))
            firsts, lasts = -(-low // q), np.minimum(2 * low - 1, length // 2) // q
            run = np.repeat(np.arange(len(q)), np.maximum(lasts - firsts + 1, 0))
            p = (firsts[run] + _ranges(np.maximum(lasts - firsts + 1, 0))) * q[run]
            begin = first[np.searchsorted(first, start[run], "right") - 1]
            lead = begin + -(-(start[run] - begin) // p) * p
            n = np.maximum(-(-(start[run] + length[run] - p - lead) // p), 0)
            skip = np.unique(np.repeat(p, n) * np.int64(len(codes) + 1) + np.repeat(lead, n) + _ranges(n) * np.repeat(p, n))
        periods = np.minimum(2 * low - 1, sizes[docs] // 2) - low + 1
        doc = np.repeat(docs, periods)
        period = low + _ranges(periods)
        upto = np.cumsum((sizes[doc] - 1) // period)
        for some in np.split(np.arange(len(doc)), np.nonzero(np.diff(upto // PROBES))[0] + 1):
            new = _stretches(codes, first, doc[some], period[some], skip, least)
            if len(new[0]):
                found.append(new)
        low *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 4
    doc, start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return doc[order], start[order], length[order], period[order]


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words alone: hashes, unless two words that differ share one."""
    hashes = tk.span_hashes(data, starts, ends)
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    size, like = ends - starts, one[which]
    if len(starts) and not ((size == size[like]).all() and tk.same_bytes(data, starts, data, starts[like], size).all()):
        raw, known = data.tobytes(), {}
        return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return which.astype(np.int32)


def _block(off: np.ndarray, data: np.ndarray, least: int, with_text: bool) -> dict[str, list]:
    starts, ends, first = tk.word_bounds(off, data)
    doc, start, length, period = find_runs(_codes(data, starts, ends), first, least)
    kept = np.zeros(len(starts) + 1, np.int32)
    np.add.at(kept, start + period, 1)
    np.add.at(kept, start + length, -1)
    kept = np.cumsum(kept[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[first]
    # bytes of kept words, and one space after each but a document's last
    words, out = np.nonzero(kept)[0], data.copy()
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[words]] = 1
    edge[ends[words]] -= 1
    take = np.cumsum(edge[:-1]).astype(bool)
    inner = np.ones(len(words), bool)
    inner[left[1:][left[1:] > left[:-1]] - 1] = False
    take[ends[words[inner]]] = True
    out[ends[words[inner]]] = 32
    at, out = np.concatenate([[0], np.cumsum(take)])[off], memoryview(out[take])
    n, runs_of = len(off) - 1, np.searchsorted(doc, np.arange(len(off)))
    rows: dict[str, list] = {c: [None] * n for c in ("start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256", "collapsed")}
    nothing = hashlib.sha256().hexdigest()
    for d in range(n):
        a, b = runs_of[d], runs_of[d + 1]
        own = list(zip((start[a:b] - first[d]).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
        if own:
            rows["start"][d], rows["length"][d], rows["period"][d] = s, size, p = min(own, key=lambda r: (-r[1], r[0], r[2]))
            rows["exponent_milli"][d] = 1000 * size // p
        rows["runs"][d] = [{"start": s, "length": size, "period": p} for s, size, p in own]
        rows["runs_sha256"][d] = hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in own).encode()).hexdigest() if own else nothing
        text = out[at[d] : at[d + 1]]
        rows["collapsed_sha256"][d] = hashlib.sha256(text).hexdigest()
        if with_text:
            rows["collapsed"][d] = str(text, "utf-8")
    return {"n_words": np.diff(first).tolist(), "n_runs": np.diff(runs_of).tolist(), "n_kept": np.diff(left).tolist()} | rows


def _found(least: int, with_text: bool):
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = {"runs": run_type, "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "collapsed": pa.string()}
    names = [x.split()[0] for x in SCHEMA.replace("struct<start:long,length:long,period:long>", "x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, off, data in tk.blocks(batch.column(1)):
                rows = _block(off, data, least, with_text)
                columns = [batch.column(0).slice(row, len(off) - 1)] + [pa.array(rows[c], kinds.get(c, pa.int64())) for c in names[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def periodic_runs(docs: DataFrame, least: int = 12, with_text: bool = True) -> DataFrame:
    """All maximal runs of words of whole texts, and the texts without their repetitions; no shuffle.

    Words are runs of other characters than space and tab to carriage return. A run is a stretch with smallest period q (words
    q apart are equal) and at least ``least`` and 2q words that can't be extended with that period. A word is dropped
    if a run has it after its first q words. Returns, a row for each row of ``docs``: doc_id, n_words, n_runs, start, length, period and
    exponent_milli (1000 * length / period, rounded down) of the longest run (ties: smallest start, then period; null without a
    run), runs (by start and period), runs_sha256 (of ``start,length,period`` lines), n_kept, collapsed_sha256 and, ``with_text``, collapsed: kept words joined by one
    space. Null, empty and wordless texts have no words; null and repeated doc_ids are kept as they are; other columns are ignored. An empty table
    gives an empty result. A text is held by one task with some 100 bytes for each of its words; periods go up to half its words.
    """
    return docs.select("doc_id", "text").mapInArrow(_found(least, with_text), SCHEMA)
