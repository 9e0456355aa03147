"""Licence scan: a positional index of licence texts, asked by each file's rarest licence words.

The index has, for each word of the licence texts, its postings (template, place). How many files have a word is counted over all
files. A file asks with the rarest of the words that it shares with a template: each of their places in the file and each posting
give the place where the template would start. Starts on which two of them agree are compared word by word with the template;
a label is given where enough of the template's weight stands and all of its key phrases do.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

# Notices and terms of public licences, each with the phrases that it can't lack.
_TERMS = [
    ("mit", "released under the MIT License", ["mit license"]),
    ("mit", "licensed under the MIT License", ["mit license"]),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "deal in the software without restriction"],
    ),
    ("apache", "licensed under the Apache License, Version 2.0", ["apache license version"]),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses license"]),
    ("gpl", "licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "licensed under the GNU General Public License, version 2", ["gnu general public license"]),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["redistribute it and or modify it", "gnu general public license"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl", "licensed under the GNU Affero General Public License", ["gnu affero general public license"]),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("bsd", "released under the BSD License", ["bsd license"]),
    ("bsd", "licensed under the BSD 3-Clause License", ["bsd 3 clause license"]),
    ("bsd", "licensed under the BSD 2-Clause License", ["bsd 2 clause license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl", "licensed under the Mozilla Public License, version 2.0", ["mozilla public license"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("epl", "licensed under the Eclipse Public License, version 2.0", ["eclipse public license"]),
    ("isc", "released under the ISC License", ["isc license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0", "licensed under CC0 1.0", ["cc0 1 0"]),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain", ["dedicated all copyright and related"]),
]
_CC_NAMES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# End of the fixed values.

#: A word is a run of digits, letters and all characters beyond ASCII; the others become spaces, A-Z small letters.
_CLASS = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _CLASS[_low : _high + 1] = np.arange(_low, _high + 1)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...]


def words_of(text: str) -> tuple[str, ...]:
    return tuple(_CLASS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode().split())


def templates() -> list[Template]:
    """All terms; Creative Commons notices by name and number, in the versions 4.0 and 3.0."""
    terms = list(_TERMS)
    for (short, name), version in product(_CC_NAMES.items(), ("4.0", "3.0")):
        label = f"cc-{short.lower()}"
        terms.append((label, f"licensed under CC {short} {version}", [f"cc {short} {version}"]))
        terms.append((label, f"licensed under a Creative Commons {name} {version} International License", [f"creative commons {name} {version}"]))
    return [Template(label, words_of(text), tuple(words_of(k) for k in keys)) for label, text, keys in terms]


class LicenceIndex:
    """Postings of the templates' words, and the words of the counted phrases."""

    def __init__(self, terms: Sequence[Template], phrases: Sequence[tuple[str, str]]):
        self.terms = list(terms)
        self.phrases = [(words_of(p), label) for p, label in phrases]
        spelt = sorted({w for t in terms for w in t.words} | {w for t in terms for k in t.keys for w in k} | {w for p, _ in self.phrases for w in p})
        self.words, self.number = spelt, {w: i for i, w in enumerate(spelt)}
        raw = [w.encode() for w in spelt]
        ends = np.cumsum([len(w) for w in raw])
        self.data, self.starts = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64)
        hashes = tk.span_hashes(self.data, self.starts, ends)
        self.order = np.argsort(hashes)
        self.hashes, self.sizes = hashes[self.order], np.diff(np.concatenate([[0], ends]))
        self.rows = [np.array([self.number[w] for w in t.words]) for t in terms]
        self.counts = np.zeros((len(spelt), len(self.terms)))
        for t, row in enumerate(self.rows):
            np.add.at(self.counts, (row, t), 1)
        self.postings: list[dict[int, list[int]]] = []
        for row in self.rows:
            places = defaultdict(list)
            for y, w in enumerate(row.tolist()):
                places[w].append(y)
            self.postings.append(places)

    def read(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word of a block or -1, first word of each text and of the end)."""
        data = _CLASS[data]
        starts, ends, first = tk.word_bounds(off, data)
        hashes, size = tk.span_hashes(data, starts, ends), ends - starts
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        number = np.where(self.hashes[place] == hashes, self.order[place], -1)
        known = np.nonzero(number >= 0)[0]
        same = size[known] == self.sizes[number[known]]
        same[same] = tk.same_bytes(data, starts[known[same]], self.data, self.starts[number[known[same]]], size[known[same]])
        number[known[~same]] = -1
        return number, first

    def at(self, numbers: np.ndarray, phrase: Sequence[str]) -> np.ndarray:
        """Places where the phrase's words stand one after another (across texts too: the caller looks)."""
        wanted = [self.number[w] for w in phrase]
        n = len(numbers) - len(wanted) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        places = np.nonzero(numbers[:n] == wanted[0])[0]
        for k, w in enumerate(wanted[1:], 1):
            places = places[numbers[places + k] == w]
        return places


_indexes: dict = {}


def _index(terms: tuple[Template, ...], phrases: tuple) -> LicenceIndex:
    if (terms, phrases) not in _indexes:
        _indexes[terms, phrases] = LicenceIndex(terms, phrases)
    return _indexes[terms, phrases]


def _presence(index: LicenceIndex, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each text has each of the index's words."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    have = np.zeros((len(first) - 1, len(index.words)), bool)
    known = numbers >= 0
    have[doc[known], numbers[known]] = True
    return have


def _counted(terms: tuple[Template, ...], phrases: tuple):
    """One row for each word and partition: how many of its texts have the word; number -1 has the texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(terms, phrases)
        total, files = np.zeros(len(index.words), np.int64), 0
        for batch in batches:
            for _, off, data in tk.blocks(batch.column(0)):
                total += _presence(index, *index.read(off, data)).sum(0)
                files += len(off) - 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([files, *total.tolist()], pa.int64())], names=["word", "files"])

    return run


def _matches(index: LicenceIndex, own: np.ndarray, t: int, weight: np.ndarray, rarest: int, least: float) -> float:
    """The greatest share of template t's weight that stands at one start in a file with all key phrases, if it is ``least`` or more; else 0."""
    row, postings = index.rows[t], index.postings[t]
    asked = sorted((w for w in np.unique(own[own >= 0]).tolist() if w in postings), key=lambda w: (-weight[w], index.words[w]))[:rarest]
    starts = [np.unique((np.nonzero(own == w)[0][:, None] - np.array(postings[w])[None, :]).ravel()) for w in asked]
    if not starts:
        return 0.0
    found, agree = np.unique(np.concatenate(starts), return_counts=True)
    best, total = 0.0, weight[row].sum()
    for s in found[agree >= min(2, len(postings))].tolist():
        a, b = max(-s, 0), min(len(row), len(own) - s)
        share = round(float(weight[row[a:b]][own[s + a : s + b] == row[a:b]].sum() / total), 6)
        part = own[s + a : s + b]
        if share >= least and share > best and all(len(index.at(part, key)) for key in index.terms[t].keys):
            best = share
    return best


def _scanned(terms: tuple[Template, ...], phrases: tuple, weight: np.ndarray, rarest: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(terms, phrases)
        totals = np.array([weight[row].sum() for row in index.rows])
        for batch in batches:
            for r, off, data in tk.blocks(batch.column(1)):
                numbers, first = index.read(off, data)
                n = len(off) - 1
                labels: list[set[str]] = [set() for _ in range(n)]
                base: list[set[str]] = [set() for _ in range(n)]
                n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                for words, label in index.phrases:
                    at = index.at(numbers, words)
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + len(words) <= first[doc + 1]
                    at, doc = at[inside], doc[inside]
                    np.add.at(n_base, doc, 1)
                    np.minimum.at(low, doc, at - first[doc])
                    np.maximum.at(high, doc, at - first[doc])
                    for d in np.unique(doc).tolist():
                        base[d].add(label)
                score = np.zeros(n)
                # what a file's words could weigh at most at any start
                most = _presence(index, numbers, first) @ (index.counts * weight[:, None]) / totals
                for d, t in zip(*np.nonzero(most >= least - 1e-6), strict=True):
                    share = _matches(index, numbers[first[d] : first[d + 1]], t, weight, rarest, least)
                    if share:
                        labels[d].add(index.terms[t].label)
                        score[d] = max(score[d], share)
                said = lambda sets: [",".join(sorted(s)) for s in sets]
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(r, n), pa.array(np.diff(first)), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none), pa.array(said(base)), pa.array(said([a | b for a, b in zip(base, labels, strict=True)])), pa.array(score)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def scan_licences(docs: DataFrame, terms: Sequence[Template] | None = None, phrases: Sequence[tuple[str, str]] = PHRASES, rarest: int = 8, least: float = 0.6) -> DataFrame:
    """Labels of the licences that each whole text names or quotes.

    A word weighs ln(1 + (N + 1) / (n + 1)), n of all N texts having it; these few hundred counts are summed by Spark and fetched, whatever the
    corpus. A text asks with the ``rarest`` words of most weight (ties: by word) that it shares with a template. A start on which two of them
    agree is a match if words of ``least`` of the template's weight stand at their places and all key phrases do within it. Templates that the words of a text
    can't reach, wherever they stand, are passed over.
    Returns, a row for each row of ``docs``: doc_id, n_words, n_base (places of ``phrases``), first_word and last_word (their smallest and largest start; null without
    any), base_labels (of phrases found), labels (these and those of matched templates; both distinct, sorted, joined by commas, empty without any),
    score (greatest matched share, 0 without a match). Null and empty texts have no words; null and repeated doc_ids are kept as they are; other columns are
    ignored. An empty table gives an empty result.
    """
    terms, phrases = tuple(templates() if terms is None else terms), tuple(phrases)
    index = LicenceIndex(terms, phrases)
    counts = docs.select(F.col("text")).mapInArrow(_counted(terms, phrases), "word int, files long").groupBy("word").agg(F.sum("files").alias("files"))
    have = {r["word"]: r["files"] for r in counts.collect()}  # a row for each word of the index
    weight = np.array([math.log(1 + (have.get(-1, 0) + 1) / (have.get(i, 0) + 1)) for i in range(len(index.words))])
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(_scanned(terms, phrases, weight, rarest, least), schema)
