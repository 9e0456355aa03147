"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

Each document's set of word shingles gets a signature of 64 symbols of 16 bits (the
low bits of 64 minima). The 64 symbols are split into 16 chunks of 4. Two signatures
that differ in at most ``MAX_DISTANCE`` = 31 symbols have, by pigeonhole, a chunk
with at most one error; so every chunk is filed under each of the four keys that
leave out one of its symbols (one key for each place of an allowed error), and such
a pair must share a key. Sets of similarity 0.8 differ in 12.8 symbols on average
(deviation 3.2): a distance over 31 has a chance below 1e-7.

No key's group is expanded into pairs. First all members of a key are
compared with the key's smallest and greatest document; then the keys whose members
are still in different components are compared in blocks, which gives one link for
two components. Links are confirmed on the full shingle sets,
by hashes other than those that led to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components
from .scratch import materialize

SYMBOLS, CHUNK, MAX_DISTANCE = 64, 4, 31
#: Documents of a block, and so rows compared at once, and the shingles of all of them (a longer text is a block of its own in effect).
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Two blocks with more near pairs are compared as wholes.
MANY = 256
#: Pairs confirmed at once, and the bytes of their texts (a longer pair is confirmed by itself).
PAIRS, PAIR_BYTES = 256, 4 << 20
#: Salt of the hashes with which links are confirmed, so that no collision confirms itself.
OTHER = 1
_SEEDS = np.random.default_rng(977).integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(off: np.ndarray, data: np.ndarray, words: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first of each text and of the end) of a block of texts, A-Z lower-cased.

    A text with at least one and fewer than ``words`` words has its whole sequence as one.
    Another ``salt`` gives independent hashes of the words.
    """
    data = tk.LOWER[data]
    starts, ends, first = tk.word_bounds(off, data)
    h = tk.span_hashes(data, starts, ends, salt)
    counts = np.diff(first)
    wide = tk.window_hashes(h, words)
    keep = np.zeros(len(h), bool)
    text = np.repeat(np.arange(len(counts)), counts)
    if len(wide):
        keep[: len(wide)] = text[: len(wide)] == text[words - 1 :]
    out = h.copy()
    out[: len(wide)] = wide
    for i in np.nonzero((counts > 0) & (counts < words))[0]:  # a few very short texts
        whole = h[first[i]]
        for x in h[first[i] + 1 : first[i + 1]]:
            whole = tk.pair_hash(np.array([whole]), np.array([x]), 77)[0]
        out[first[i]] = tk.mix(np.array([whole]), int(counts[i]) + 100)[0]
        keep[first[i]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes of each text, their bounds, the place of each in ``h``)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(h)
    order = order[np.argsort(text[order], kind="stable")]
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(first))), order[new]


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, off, data in tk.blocks(batch.column(1)):
                h, first, one = _distinct(*shingle_hashes(off, data, words))
                other = shingle_hashes(off, data, words, OTHER)[0][one]
                size = np.diff(first)
                full = np.nonzero(size)[0]
                sig = np.zeros((len(size), SYMBOLS), np.uint16)
                prints = np.zeros((2, len(size)), np.uint64)
                if len(full):
                    at = first[full]
                    for j, seed in enumerate(_SEEDS):
                        low = np.minimum.reduceat((h * seed) >> np.uint64(24), at)
                        sig[full, j] = (tk.mix(low, j) & np.uint64(0xFFFF)).astype(np.uint16)
                    prints[0, full] = np.add.reduceat(tk.mix(h, 5), at)
                    prints[1, full] = np.add.reduceat(tk.mix(other, 6), at)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(size)), pa.array(size), tk.long_array(prints[0]), tk.long_array(prints[1]), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "sig"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS // CHUNK, CHUNK).astype(np.uint64)
            out = []
            for c in range(SYMBOLS // CHUNK):
                for error in range(CHUNK):
                    key = np.full(len(sig), c * CHUNK + error, np.uint64)
                    for s in range(CHUNK):
                        if s != error:
                            key = key << np.uint64(16) | sig[:, c, s]
                    out.append(key)
            ids = np.asarray(part.column(0))
            yield pa.RecordBatch.from_arrays([tk.long_array(np.concatenate(out)), pa.array(np.tile(ids, len(out)))], names=["key", "doc_id"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are near; (a, b, sig_a, sig_b)."""
    for batch in batches:
        if batch.num_rows:
            sig = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array((sig[0] != sig[1]).sum(1) <= MAX_DISTANCE))


def _pair_spans(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """(first, number) of the pairs confirmed at once, of a batch with their texts in columns 2 and 3."""
    ends = np.cumsum(sum(np.asarray(pc.binary_length(batch.column(i)).fill_null(0), np.int64) for i in (2, 3)))
    at = 0
    while at < len(ends):
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_BYTES, "right"))
        n = min(max(full - at, 1), PAIRS)
        yield at, n
        at += n


def _confirm(words: int, percent: int):
    """Pairs whose full sets are similar enough; (a, b, text_a, text_b)."""

    def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        hs, sizes = [], []
        for _, off, data in tk.blocks(texts):
            h, first, _ = _distinct(*shingle_hashes(off, data, words, OTHER))
            hs.append(h)
            sizes.append(np.diff(first))
        return np.concatenate(hs), np.concatenate(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _pair_spans(batch):
                part = batch.slice(at, n)
                (ha, na), (hb, nb) = sets(part.column(2)), sets(part.column(3))
                h, pair = np.concatenate([ha, hb]), np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
                order = np.argsort(h)
                order = order[np.argsort(pair[order], kind="stable")]
                h, pair = h[order], pair[order]
                both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=len(na))
                yield part.select([0, 1]).filter(pa.array(100 * both >= percent * (na + nb - both)))

    return run


def _row_spans(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.offsets)


def _near_in_blocks(percent: int, many: int):
    """Near signatures of different components in pairs of blocks; (block_a, block_b, cards_a, cards_b).

    Gives the pairs of documents (a, b), or, if there are more than ``many`` of them, one row
    without a and b: such blocks are compared as wholes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for i in (2, 3):
                column = batch.column(i)
                cards = column.values
                sig = np.frombuffer(b"".join(cards.field("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                sides.append((_row_spans(column), sig, *(np.asarray(cards.field(x)) for x in ("component", "doc_id", "n_shingles"))))
            blocks = [np.asarray(batch.column(i)) for i in (0, 1)]
            for row in range(batch.num_rows):
                (sig_a, of_a, id_a, n_a), (sig_b, of_b, id_b, n_b) = ([x[s[0][row] : s[0][row + 1]] for x in s[1:]] for s in sides)
                apart = np.zeros((len(id_a), len(id_b)), np.uint8)
                for k in range(SYMBOLS):
                    apart += sig_a[:, k, None] != sig_b[None, :, k]
                low, high = np.minimum(n_a[:, None], n_b[None, :]), np.maximum(n_a[:, None], n_b[None, :])
                hit = (apart <= MAX_DISTANCE) & (100 * low >= percent * high) & (of_a[:, None] != of_b[None, :])
                if blocks[0][row] == blocks[1][row]:
                    hit &= id_a[:, None] < id_b[None, :]
                i, j = np.nonzero(hit)
                whole = len(i) > many
                n = 1 if whole else len(i)
                pair = [pa.nulls(1, pa.int64())] * 2 if whole else [pa.array(id_a[i]), pa.array(id_b[j])]
                if n:
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, x[row])) for x in blocks), *pair], names=["block_a", "block_b", "a", "b"])

    return run


def _shared_counts(ha: np.ndarray, a: np.ndarray, na: int, hb: np.ndarray, b: np.ndarray, nb: int, width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of na sets with nb sets, given as (hash, owner)."""
    counts = np.zeros((na, nb), np.int64)
    common = np.intersect1d(ha, hb)
    for at in range(0, len(common), width):
        part = common[at : at + width]
        sides = []
        for h, owner, n in ((ha, a, na), (hb, b, nb)):
            place = np.minimum(np.searchsorted(part, h), len(part) - 1)
            has = part[place] == h
            one = np.zeros((n, len(part)), np.float32)
            one[owner[has], place[has]] = 1
            sides.append(one)
        counts += (sides[0] @ sides[1].T).astype(np.int64)
    return counts


def _block_links(words: int, percent: int):
    """One link for any two components that have one between two blocks; (texts_a, texts_b)."""

    def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [_distinct(*shingle_hashes(off, data, words, OTHER)) for _, off, data in tk.blocks(texts)]
        sizes = np.concatenate([np.diff(first) for _, first, _ in found])
        return np.concatenate([h for h, _, _ in found]), np.repeat(np.arange(len(sizes)), sizes), sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cards = [batch.column(i).slice(row, 1).flatten() for i in (0, 1)]
                (ha, a, na), (hb, b, nb) = (sets(c.field("text")) for c in cards)
                both = _shared_counts(ha, a, len(na), hb, b, len(nb))
                of = [np.asarray(c.field("component")) for c in cards]
                hit = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (of[0][:, None] != of[1][None, :])
                i, j = np.nonzero(hit)
                _, one = np.unique(np.stack([of[0][i], of[1][j]]), axis=1, return_index=True)
                ids = [np.asarray(c.field("doc_id")) for c in cards]
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][i[one]]), pa.array(ids[1][j[one]])], names=["a", "b"])

    return run


def _confirmed_on_texts(pairs: DataFrame, texts: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    for side in ("a", "b"):
        # by sort and merge at every size: the pairs grow with the documents, and both joins share one exchange of the texts
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")).hint("merge"), side)
    return materialize(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, percent), "a long, b long"), f"{name}-links")


def _links_between_blocks(marked: DataFrame, reps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of one key that are in different components; ``marked`` has (key, doc_id, component, largest, members).

    Documents go into blocks of about ``BLOCK``, by the key of theirs with most members
    (documents that share a passage share many keys, and so meet in few blocks), those of that key's largest
    component apart. In each key, blocks with a document outside its largest component
    meet all blocks of the key; pairs of blocks are compared by signatures. Few near pairs are confirmed one by one;
    blocks with many are compared on full sets without a row for each pair of documents.
    """
    place = marked.groupBy("doc_id", "component").agg(F.max_by(F.struct("key", "largest"), F.struct("members", "key")).alias("at"))
    place = place.select("doc_id", "component", F.col("at.key").alias("label"), (F.col("component") == F.col("at.largest")).alias("inside"))
    place = materialize(place, "labels")
    sized = place.join(reps.groupBy("doc_id").agg(F.max("n_shingles").alias("n")), "doc_id")
    count = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    dealt = place.join(materialize(sized.groupBy("label", "inside").agg(count.alias("blocks")), "block-counts"), ["label", "inside"])
    placed = materialize(dealt.select("doc_id", "component", F.xxhash64("label", "inside", F.pmod(F.xxhash64("doc_id"), "blocks")).alias("block")), "placed")
    met = marked.join(placed.select("doc_id", "block"), "doc_id").groupBy("key", "block").agg(F.max(F.col("component") != F.col("largest")).alias("other"))
    met = materialize(met, "met")
    pairs = met.where("other").select("key", F.col("block").alias("x")).join(met.select("key", F.col("block").alias("y")), "key")
    pairs = pairs.select(F.least("x", "y").alias("block_a"), F.greatest("x", "y").alias("block_b")).distinct()

    def on_both_sides(pairs: DataFrame, cards: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(cards.select(F.col("block").alias(f"block_{side}"), F.col("cards").alias(f"cards_{side}")), f"block_{side}")
        return pairs

    cards = placed.join(reps.select("doc_id", "n_shingles", "sig"), "doc_id").groupBy("block").agg(F.collect_list(F.struct("component", "doc_id", "n_shingles", "sig")).alias("cards"))
    near = on_both_sides(materialize(pairs, "block-pairs"), materialize(cards, "cards")).select("block_a", "block_b", "cards_a", "cards_b")
    near = materialize(near.mapInArrow(_near_in_blocks(percent, MANY), "block_a long, block_b long, a long, b long"), "near-in-blocks")
    single = near.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _confirmed_on_texts(single, texts, words, percent, "second")
    whole = near.where("a IS NULL").select("block_a", "block_b")
    if whole.isEmpty():
        return links
    wanted = materialize(placed.join(whole.select(F.explode(F.array("block_a", "block_b")).alias("block")).distinct(), "block"), "whole-blocks")
    cards = texts.join(wanted, "doc_id").groupBy("block").agg(F.collect_list(F.struct("doc_id", "component", "text")).alias("cards"))
    found = on_both_sides(whole, materialize(cards, "block-texts")).select("cards_a", "cards_b")
    return links.unionByName(materialize(found.mapInArrow(_block_links(words, percent), "a long, b long"), "block-links"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Class of near duplicates of each document: (doc_id, n_shingles, component_id, kept).

    A document's set holds its distinct ``words``-word shingles (words are runs of
    non-space bytes, A-Z lower-cased); two documents are linked if 100 * intersection
    >= ``percent`` * union. component_id is the smallest doc_id reachable by links.
    Null, empty and wordless texts have no shingle, are linked with nothing and are
    kept. Repeated texts are equal sets and so linked; rows that repeat a doc_id get
    the class of their own text each; rows without doc_id are linked with nothing, have a null class and are
    kept. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    sigs = docs.select("doc_id", "text").mapInArrow(_signatures(words), "doc_id long, n_shingles long, print_a long, print_b long, sig binary")
    sigs = materialize(sigs, "signatures")
    # equal sets (which have equal signatures) meet in their smallest document, which stands for them
    same = ["n_shingles", "print_a", "print_b"]
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    heads = materialize(full.groupBy(*same, "sig").agg(F.min("doc_id").alias("head")), "heads")
    reps = heads.select(F.col("head").alias("doc_id"), "n_shingles", "sig")
    keys = reps.select("doc_id", "sig").mapInArrow(_keys, "key long, doc_id long")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = materialize(shared.select("key", "low", "high"), "shared-keys")
    filed = materialize(keys.join(shared, "key"), "filed")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        for side in ("a", "b"):
            pairs = pairs.join(reps.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
        small = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        pairs = pairs.where(small).select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a long, b long")
        return _confirmed_on_texts(materialize(pairs, f"{name}-near"), texts, words, percent, name)

    links = confirmed(filed.select(F.col("doc_id").alias("a"), F.col("low").alias("b")).unionByName(filed.select(F.col("doc_id").alias("a"), F.col("high").alias("b"))), "first")
    labels = connected_components(links)
    # what is left: members of one key in different components, compared block by block
    classed = filed.select("key", "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    classed = materialize(classed, "classed")
    groups = classed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    split = groups.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    marked = materialize(classed.join(split, "key"), "marked")
    links = links.unionByName(_links_between_blocks(marked, reps, texts, words, percent))
    labels = connected_components(links).withColumnRenamed("id", "head")
    classes = heads.join(labels, "head", "left").select(*same, F.coalesce("component", "head").alias("component_id"))
    out = full.join(classes, same).select("doc_id", "n_shingles", "component_id")
    alone = sigs.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
