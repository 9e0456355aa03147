"""Removal of repeated word windows by level-wise doubling.

Windows of 7 words come first: each full window samples one of them (see ``levels``).
Those that occur in one document alone end there, with all full windows that sampled
them; the others are extended to 13, 25 and 50 words, and after each step go on only if they occur in
two documents, until no candidates survive or the full length is reached. Full windows
are compared by 128 hashed bits of two independent hashes, shorter ones by 64 (a false
match there only lets a candidate pass). Copies of whole texts need no window: all
but the smallest document's are removed as wholes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .levels import followed, lengths
from .scratch import bucketed, materialize

#: Salt of the second, independent hash of words.
OTHER = 1


def text_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def within(first: np.ndarray, length: int) -> np.ndarray:
    """Of each item of a block: whether ``length`` items of its text start here."""
    text = text_of(first)
    ok = np.zeros(len(text), bool)
    if len(text) >= length:
        ok[: len(text) - length + 1] = text[: len(text) - length + 1] == text[length - 1 :]
    return ok


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list<long> column; null lists are empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    return np.asarray(values).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(column)), sizes)


def salted(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return h ^ tk.mix(row.astype(np.uint64), 31)


def member_of(h: np.ndarray, row: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each (hash, row) is among (values, rows)."""
    if not len(values) or not len(h):
        return np.zeros(len(h), bool)
    known = np.sort(salted(values, rows))
    asked = salted(h, row)
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return known[place] == asked


def list_column(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """list<long> column of (value, row), rows ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), tk.long_array(values))


def _level_hashes(h: np.ndarray, steps: list[int], level: int) -> np.ndarray:
    """Of each start of a full window: the hash of the window of length ``steps[level]`` that it is followed by."""
    first = tk.window_hashes(h, steps[0])
    if level == 0:
        return tk.sliding(first, steps[-1] - steps[0] + 1, True)
    return tk.window_hashes(h, steps[level])[followed(first, steps, level)]


def _distinct_of_rows(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return values, row
    order = np.argsort(values)
    order = order[np.argsort(row[order], kind="stable")]
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], row[new]


def _alive(h: np.ndarray, first: np.ndarray, steps: list[int], level: int, live: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Which starts of full windows are candidates at ``level``: those whose window of the level before is among ``live``."""
    ok = within(first, steps[-1])[: max(len(h) - steps[-1] + 1, 0)]
    if level and ok.any():
        ok &= member_of(_level_hashes(h, steps, level - 1), text_of(first)[: len(ok)], *live)
    return ok


def _picks(steps: list[int], level: int):
    """(doc_id, text, live of the level before) -> distinct hashes of this level's windows of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, off, data in tk.blocks(batch.column(1)):
                n = len(off) - 1
                starts, ends, first = tk.word_bounds(off, data)
                h = tk.span_hashes(data, starts, ends)
                ok = _alive(h, first, steps, level, lists(batch.column(2).slice(row, n)) if level else None)
                values, rows = (_level_hashes(h, steps, level)[ok], text_of(first)[: len(ok)][ok]) if ok.any() else (h[:0], first[:0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), list_column(*_distinct_of_rows(values, rows), n)], names=["doc_id", "picks"])

    return run


def _candidates(steps: list[int]):
    """Hashes of the full windows that are candidates; (doc_id, text, live)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for row, off, data in tk.blocks(batch.column(1)):
                starts, ends, first = tk.word_bounds(off, data)
                h = tk.span_hashes(data, starts, ends)
                level = len(steps) - 1
                hit = np.nonzero(_alive(h, first, steps, level, lists(batch.column(2).slice(row, len(off) - 1)) if level else None))[0]
                if len(hit):
                    text = text_of(first)[hit]
                    a, b = (tk.window_hashes(x, steps[-1])[hit] for x in (h, tk.span_hashes(data, starts, ends, OTHER)))
                    _, one = np.unique(salted(a, text), return_index=True)  # a window that a text repeats counts once
                    yield pa.RecordBatch.from_arrays([tk.long_array(a[one]), tk.long_array(b[one]), pa.array(ids[row + text[one]])], names=["a", "b", "doc_id"])

    return run


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): kept words of each text, each with a space after it."""
    s, size = starts[keep], (ends - starts)[keep] + 1
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(s - at[:-1], size) + np.arange(at[-1])
    out = np.concatenate([data, [np.uint8(32)]])[take] if len(take) else np.zeros(0, np.uint8)
    out[at[1:] - 1] = 32
    return out, at[np.concatenate([[0], np.cumsum(keep)])[first]]


def _removals(window: int, with_text: bool, carry: tuple[str, ...] = ()):
    """(doc_id, text, gone, copies, carried columns) -> words removed and what is kept, and the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = batch.column(3).to_pylist()
            for row, off, data in tk.blocks(batch.column(1)):
                n = len(off) - 1
                starts, ends, first = tk.word_bounds(off, data)
                h = tk.window_hashes(tk.span_hashes(data, starts, ends), window)
                text = text_of(first)
                hit = within(first, window)[: len(h)] & member_of(h, text[: len(h)], *lists(batch.column(2).slice(row, n)))
                cover = np.zeros(len(starts) + 1, np.int64)
                at = np.nonzero(hit)[0]
                cover[at] += 1
                cover[at + window] -= 1
                keep = np.cumsum(cover[:-1]) == 0
                for i in range(n):
                    if copies[row + i] and first[i + 1] - first[i] >= window and hashlib.md5(data[off[i] : off[i + 1]]).hexdigest() in copies[row + i]:
                        keep[first[i] : first[i + 1]] = False
                out, ends_at = joined_words(data, starts, ends, keep, first)
                kept = [out[ends_at[i] : max(ends_at[i], ends_at[i + 1] - 1)].tobytes() for i in range(n)]
                words = np.diff(first)
                columns = [batch.column(0).slice(row, n), pa.array(words), pa.array(words - np.diff(np.concatenate([[0], np.cumsum(keep)])[first]))]
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept if with_text else [None] * n, pa.binary()).cast(pa.string())]
                columns += [batch.column(1 if c == "text" else batch.schema.get_field_index(f"_carried_{c}")).slice(row, n) for c in carry]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *[f"_carried_{c}" for c in carry]])

    return run


def copies_of(docs: DataFrame) -> DataFrame:
    """(doc_id, copies, wholly): digests under which a document repeats the whole text of a smaller doc_id.

    wholly: all rows of the document are such copies, so it has no window of its own to look for.
    """
    prints = materialize(docs.where("doc_id IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("print")), "prints")
    heads = prints.where("print IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("print", "head")
    copies = prints.join(materialize(heads, "print-heads"), "print").where("doc_id > head").groupBy("doc_id").agg(F.collect_set("print").alias("copies"), F.count(F.lit(1)).alias("n"))
    rows = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    return materialize(copies.join(rows, "doc_id").select("doc_id", "copies", (F.col("n") == F.col("rows")).alias("wholly")), "copies")


def repeated_in_documents(picks: DataFrame, value: str, name: str) -> DataFrame:
    """Rows (doc_id, ``value``) whose value another doc_id has too, as lists (doc_id, live)."""
    shared = picks.groupBy(value).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(value)
    live = picks.join(materialize(shared, f"repeated-{name}"), value).groupBy("doc_id").agg(F.collect_list(value).alias("live"))
    return materialize(live, f"live-{name}")


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = True, carry: tuple[str, ...] = (), first: int = 7, survivors: dict[int, int] | None = None) -> DataFrame:
    """Remove words covered by a ``window``-word sequence that also starts in a smaller doc_id.

    Words are runs of bytes other than space, tab to CR; windows are judged on the input.
    Returns (doc_id, n_words, n_removed, kept_sha256, kept_text): kept_text joins the kept
    words by one space (null unless ``with_text``). Null, empty and wordless texts have no
    word and keep the empty string; very long texts are handled one at a time, in some ten arrays of eight bytes for each word.
    Rows that repeat a doc_id are versions of one document: they don't remove each other's words, and
    each loses what a smaller doc_id has; rows without doc_id lose nothing. Other columns
    are ignored, but those in ``carry`` (and the input's text, if named there) are returned under
    the prefix "_carried_"; an empty table gives an empty result. ``first``: words of the first level at least
    (the results are the same); ``survivors`` is filled with the number of windows found
    repeated at each length.
    """
    steps = lengths(window, min(first, window))
    carried = [f"_carried_{c}" for c in carry if c != "text"]
    types = "".join(f", `_carried_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    docs = docs.select("doc_id", "text", *[F.col(c).alias(f"_carried_{c}") for c in carry if c != "text"])
    nameless = docs.where("doc_id IS NULL")
    known = bucketed(docs.where("doc_id IS NOT NULL"), "texts", "doc_id")
    copies = copies_of(known)
    wholly = copies.where("wholly").select("doc_id")
    live, level = None, 0
    while steps[level] < window and (live is None or not live.isEmpty()):
        asked = known.select("doc_id", "text") if live is None else known.join(live, "doc_id").select("doc_id", "text", "live")
        picks = asked.mapInArrow(_picks(steps, level), "doc_id long, picks array<long>")
        picks = (picks.join(wholly, "doc_id", "left_anti") if live is None else picks).select("doc_id", F.explode("picks").alias("pick"))
        live = repeated_in_documents(materialize(picks, f"windows-{steps[level]}"), "pick", f"{steps[level]}")
        if survivors is not None:
            survivors[steps[level]] = live.agg(F.sum(F.size("live")).alias("n")).first()["n"] or 0
        level += 1
    asked = known.select("doc_id", "text") if live is None else known.join(live, "doc_id").select("doc_id", "text", "live")
    full = materialize(asked.mapInArrow(_candidates(steps), "a long, b long, doc_id long"), f"windows-{window}")
    least = materialize(full.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a", "b", "low"), "repeated-windows")
    gone = full.join(least, ["a", "b"]).where("doc_id > low").groupBy("doc_id").agg(F.collect_set("a").alias("gone"))
    facts = gone.join(copies.select("doc_id", "copies"), "doc_id", "full_outer")
    judged = known.join(facts, "doc_id", "left").select("doc_id", "text", "gone", "copies", *carried)
    nameless = nameless.select("doc_id", "text", F.lit(None).cast("array<long>").alias("gone"), F.lit(None).cast("array<string>").alias("copies"), *carried)
    return judged.unionByName(nameless).mapInArrow(_removals(window, with_text, carry), f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string{types}")
