"""The training-data operators against brute force on small fixtures with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import mixed
from pyspark.sql import functions as F

from gatewise.llm import near_dup, sharding, suffixes, topk
from gatewise.llm.components import connected_components
from gatewise.llm.mixing import leaf_budgets, mix_sources
from gatewise.llm.near_dup import near_duplicates
from gatewise.llm.pieces import encode_pieces
from gatewise.llm.quality import quality_rules
from gatewise.llm.queries import BYTE_BPE, LEVELS, PIECE_MODEL, RULES
from gatewise.llm.sharding import shard_documents
from gatewise.llm.substrings import remove_repeats
from gatewise.llm.suffixes import remove_repeated_bytes
from gatewise.llm.token_files import read_record, read_token_files, write_token_files
from gatewise.llm.topk import top_inner_products
from gatewise.llm.urls import filter_urls

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ka", "to", "mi", "ré", "sun", "QUO"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(220), prose(60)
    out = [None, "", "   \n\t", "one", "One", "two words", base, base, base.upper()]
    for k in range(25):
        words = base.split(" ")
        for _ in range(k % 9):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    out += [prose(30) + " " + passage + "\n" + prose(rng.randint(0, 90)) for _ in range(8)]
    out += ["spam " * 300, "a" * 400, "a" * 390, passage, prose(40) + " x y", prose(20_000)]
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, "en" if i % 3 else None, f"src{i % 2}", len(t or ""), True) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def test_near_duplicates(spark):
    rows = texts()
    sets = []
    for t in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r["doc_id"]: r for r in near_duplicates(frame(spark), words=2).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(rows))] == [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("many", [256, 0])
def test_links_between_blocks(spark, monkeypatch, many):
    monkeypatch.setattr(near_dup, "MANY", many)  # 0: all blocks with a near pair are compared as wholes
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    docs = frame(spark, [t for t in texts() if t and t.strip()]).select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), r["text"].encode()))
        sets[r["doc_id"]] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    sigs = docs.mapInArrow(near_dup._signatures(2), "doc_id long, n_shingles long, print_a long, print_b long, sig binary")
    marked = docs.select(F.lit(1).cast("long").alias("key"), "doc_id", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("largest"), F.lit(len(sets)).cast("long").alias("members"))
    got = near_dup._links_between_blocks(marked, sigs, docs, 2, 80).collect()
    assert len(want) > 50 and {tuple(sorted(r)) for r in got} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def removed(units, window):
    seen: dict = {}
    for i, u in enumerate(units):
        for p in range(len(u) - window + 1):
            seen.setdefault(u[p : p + window], i)
    out = []
    for i, u in enumerate(units):
        keep = [True] * len(u)
        for p in range(len(u) - window + 1):
            if seen[u[p : p + window]] < i:
                keep[p : p + window] = [False] * window
        out.append(keep)
    return out


@pytest.mark.parametrize("first", [7, 25, 50])
def test_word_windows(spark, first):
    units = [tuple(WORD.findall((t or "").encode())) for t in texts()]
    left: dict = {}
    got = {r["doc_id"]: r for r in remove_repeats(frame(spark), first=first, survivors=left).collect()}
    assert list(left) == [n for n in (7, 13, 25) if n >= first] and all(left.values())
    for i, (u, keep) in enumerate(zip(units, removed(units, 50), strict=True)):
        kept = b" ".join(w for w, k in zip(u, keep, strict=True) if k)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(u), keep.count(False))
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest() and got[i]["kept_text"].encode() == kept


def test_versions_of_a_document_lose_what_smaller_ones_have(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randrange(10**6)}" for _ in range(n))
    passage, tail, copy = prose(70), prose(30), prose(90)
    rows = [(2, passage), (3, copy), (5, copy), (5, f"{tail} {passage}"), (5, f"{prose(20)} {passage} {prose(9)}"), (None, passage), (9, f"{tail} x"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect()))
    assert got == sorted([(2, 70, 0), (3, 90, 0), (5, 90, 90), (5, 100, 70), (5, 99, 70), (0, 70, 0), (9, 31, 0), (9, 0, 0)])
    units = [(i, (t or "").encode()) for i, t in rows]
    seen: dict = {}
    for i, u in units:
        for p in range(len(u) - 49):
            if i is not None:
                seen[u[p : p + 50]] = min(i, seen.get(u[p : p + 50], i))
    want = []
    for i, u in units:
        gone = {q for p in range(len(u) - 49) if i is not None and seen[u[p : p + 50]] < i for q in range(p, p + 50)}
        want.append((i or 0, len(u), len(gone)))
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in remove_repeated_bytes(docs).collect()) == sorted(want)


def alternating(n):
    """A string and its complement that polynomial hashes modulo a power of two don't tell apart."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_alternating_words_stay_apart(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    pairs = [*alternating(1024), *alternating(2048)]
    rows = [*pairs, " ".join(pairs), " ".join(pairs[::-1]), *(f"{p} " * 60 for p in pairs)]
    docs = frame(spark, rows)
    tokenizer, model = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = {r["doc_id"]: r for r in read_token_files(*write_token_files(docs, BYTE_BPE)).collect()}
    for i, t in enumerate(rows):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    got = {r["doc_id"]: r for r in encode_pieces(docs, PIECE_MODEL).collect()}
    assert [got[i]["ids"] for i in range(len(rows))] == [model.encode(t) for t in rows]
    near = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, words=2).collect()}
    assert near == {i: i for i in range(len(rows))}
    assert all(r["n_removed"] == 0 for r in remove_repeats(docs).collect())


@pytest.mark.parametrize(("first", "hot_from", "many_here"), [(25, 20_000, 64), (7, 20_000, 64), (13, 3, 64), (25, 20_000, 2)])
def test_byte_strings(spark, monkeypatch, first, hot_from, many_here):
    monkeypatch.setattr(suffixes, "MANY_HERE", many_here)
    units, left = [(t or "").encode() for t in texts()], {}
    got = {r["doc_id"]: r for r in remove_repeated_bytes(frame(spark), first=first, hot_from=hot_from, survivors=left).collect()}
    assert list(left) == [n for n in (7, 13, 25) if n >= first] and all(left.values())
    for i, (u, keep) in enumerate(zip(units, removed(units, 50), strict=True)):
        kept = bytes(c for c, k in zip(u, keep, strict=True) if k)
        runs = sum(not k and (p == 0 or keep[p - 1]) for p, k in enumerate(keep))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(u), keep.count(False), runs)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_quality(spark):
    got = {r["doc_id"]: r for r in quality_rules(frame(spark)).collect()}
    for i, t in enumerate(texts()):
        t = t or ""
        w = WORD.findall(t.encode())
        windows: dict = {}
        for p in range(len(w) - 2):
            windows.setdefault(tuple(w[p : p + 3]), []).append(p)
        covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x.encode())]
        want = (len(w), len(b"".join(w).decode()), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_bad_host_loses_all(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "x", None, "bad" if i < 40 else f"h{i % 5}", 0, True) if i < 39 else (i, f"{good} {i}", None, "bad" if i < 40 else f"h{i % 5}", 0, True) for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(i for i, k in got.items() if k) == list(range(40, 100))


@pytest.mark.parametrize("pull", [0, 100_000])
def test_sharding(spark, monkeypatch, pull):
    monkeypatch.setattr(sharding, "PULL", pull)
    rows = texts()
    got = sorted(shard_documents(frame(spark), 4).collect())
    sizes = [len((t or "").encode()) + 1 for t in rows]
    assert [(r["doc_id"], r["size"], r["text_crc32"]) for r in got] == [(i, s, zlib.crc32((t or "").encode())) for i, (s, t) in enumerate(zip(sizes, rows, strict=True))]
    groups: dict = {}
    for t, s in zip(rows, sizes, strict=True):
        groups[t or ""] = groups.get(t or "", 0) + s
    order = list(groups.values())

    def feasible(c):
        n, full = 1, 0
        for x in order:
            if x > c:
                return False
            n, full = (n + 1, x) if full + x > c else (n, full + x)
        return n <= 4

    loads: dict = {}
    for r in got:
        loads.setdefault(r["shard"], []).append(r)
    assert max(sum(r["size"] for r in x) for x in loads.values()) <= next(c for c in range(max(order), sum(sizes) + 1) if feasible(c))
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in loads.values())
    assert len({(r["shard"]) for r, t in zip(got, rows, strict=True) if t in (None, "")}) == 1


def test_mixing(spark):
    rows = [(i, "w " * 10, "en" if i % 2 else "de", f"src{0 if i < 300 else 1}", 0, True) for i in range(400)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), LEVELS, weights={"domain=d0": 1, "domain=d1": 1}, max_epochs=2)
    taken = {r["source"]: (r["t"], r["b"]) for r in got.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("epochs")).alias("t"), F.sum_distinct("leaf_budget").alias("b")).collect()}
    # the small domain is full at two epochs, its shortage goes to the large one
    assert taken["src1"][0] == 2000 and taken["src0"][0] in range(1980, 2001)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mix_sources(spark.createDataFrame(rows[::-1], SCHEMA), LEVELS, weights={"domain=d0": 1, "domain=d1": 1}).collect()))


def test_mixing_by_brute_force(spark):
    rng = random.Random(31)
    rows = [(i if i % 11 else None, "w " * rng.choice([0, 3, 20, 400]), rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src0", "src4", "src1", "src2", "web", None]), 0, True) for i in range(300)]
    weights = {"domain=d0": 5, "domain=d1": 2, "lang=en": 3, "lang=fr": 7, "source=src4": 2}
    domain = {"src0": "d0", "src4": "d0", "src1": "d1", "src2": "d2", "web": "other", None: "other"}
    paths = [(domain[r[3]], r[2] or "", r[3] or "") for r in rows]
    tokens = [len((r[1] or "").split()) for r in rows]
    for share in (0.3, 1.0, 1.7, 5.0):
        budgets, times = mixed([r[0] for r in rows], paths, tokens, weights, share)
        want = [(r[0], *p, n, budgets[p], t) for r, p, n, t in zip(rows, paths, tokens, times, strict=True)]
        got = mix_sources(spark.createDataFrame(rows, SCHEMA), LEVELS, budget_share=share, weights=weights, max_epochs=2)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_mixing_of_very_many_tokens(spark):
    leaves = spark.createDataFrame([(f"s{i}", 10**15) for i in range(20)], "source string, tokens long")
    got = {r["source"]: r["budget"] for r in leaf_budgets(leaves, ["source"], 2 * 10**16, {f"source=s{i}": 1000 for i in range(20)}, 2).collect()}
    assert got == {f"s{i}": 10**15 for i in range(20)}
    with pytest.raises(ValueError):
        mix_sources(frame(spark, []), LEVELS, weights={"lang=en": 0})


def test_epochs_have_orders_of_their_own(spark):
    rows = [(i, "w " * 10, "en", "src0", 0, True) for i in range(60)]
    once, twice = ({r["doc_id"] for r in mix_sources(spark.createDataFrame(rows, SCHEMA), LEVELS, budget_share=s, max_epochs=2).where(f"epochs = {n}").collect()} for s, n in ((0.5, 1), (1.5, 2)))
    assert len(once) == len(twice) == 30 and once != twice


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    uri, parts = write_token_files(frame(spark), BYTE_BPE)
    got, at = sorted(read_token_files(uri, parts).collect()), 0
    for r, t in zip(got, texts(), strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    part = parts.where("docs > 0").orderBy("part").first()["part"]
    assert read_record(uri, part, 0)[0] == 0


def test_token_files_with_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    end = "<|endoftext|>"
    rows = [f"a {end} b", f"a{end}b", end, f" {end}", f"{end}  {end}\n{end}{end} x", f"a  {end}  b {end[:-1]} >", f"one two{end} three", "plain", None]
    uri, parts = write_token_files(frame(spark, rows), BYTE_BPE)
    got, at = sorted(read_token_files(uri, parts).collect()), 0
    assert len(got) == len(rows)
    for r, t in zip(got, rows, strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = [*texts(), "  two  spaces ", "日本\n語 🙂", "x" * 900]
    got = {r["doc_id"]: r for r in encode_pieces(frame(spark, rows), PIECE_MODEL).collect()}
    assert [got[i]["ids"] for i in range(len(rows))] == [model.encode(t or "") for t in rows]
    assert all(r["round_trip"] for r in got.values())


def best_of(ids, vectors, k=10):
    """Brute force over rows (id, whole numbers): the ids divisible by 100 against all rows of other ids, equal query rows once."""
    want = []
    for i in sorted({i for i in ids if i % 100 == 0}):
        own = {tuple(v) for j, v in zip(ids, vectors, strict=True) if j == i}
        pairs = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for q in own for j, v in zip(ids, vectors, strict=True) if j != i)
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(pairs[:k])]
    return want


def whole(v):
    return [[int(math.floor(1024 * x)) for x in r] for r in v]


@pytest.mark.parametrize(("roots", "page"), [(64, 1024), (2, 40), (1, 20)])
def test_top_k(spark, monkeypatch, roots, page):
    monkeypatch.setattr(topk, "ROOTS", roots)
    monkeypatch.setattr(topk, "PAGE", page)
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(700, 8)) * rng.choice([0.1, 1, 5], (700, 1))).tolist()
    v[50:300] = [v[50]] * 250
    rows = [(i, x) for i, x in enumerate(v)] + [(700, None), (800, [1.0] * 7 + [float("nan")]), (900, [1.0] * 7 + [None])]
    got = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == best_of(range(700), whole(v))


def test_top_k_of_repeated_query_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROOTS", 2)
    rng = np.random.default_rng(3)
    v = np.concatenate([np.ones((60, 8)), rng.normal(size=(100, 8))]) + rng.normal(size=(160, 8)) * 0.01
    ids = [0] * 30 + list(range(1, 131))  # thirty rows of one query id, among near vectors with other ids
    v[:28] = v[0] * 1.1
    v[29] = -v[29]
    data = [(i, x.tolist(), 1, "v") for i, x in zip(ids, v, strict=True)]
    got = top_inner_products(spark.createDataFrame(data, "vec_id long, embedding array<double>, query_id int, q string")).collect()
    assert sorted(map(tuple, got)) == best_of(ids, whole(v.tolist()))


def test_top_k_of_odd_vectors(spark):
    v = [[1.0, 2.0, -3.0], [1e16, -1e16, 1e16], [2.0, 1.0, 0.0], [1e17, 0.0, 0.0], [-1e17, 1e16, 1.0], [0.5, 0.5, 0.5], [0.0, 0.0, 0.0], [1e10, 1e10, -1e10]]
    ids = [0, 1, 2, 100, 4, 5, 200, 7]
    rows = list(zip(ids, v, strict=True)) + [(300, [1.0, 2.0]), (9, []), (None, [1.0, 1.0, 1.0]), (10, [1e200, 0.0, 0.0]), (11, [float("inf"), 0.0, 0.0])]
    got = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    cut = lambda s: max(min(s, 2**63 - 1), -(2**63))
    all_ids, all_v = [*ids, 300, 9], [*whole(v), [1024, 2048, 0], [0, 0, 0]]
    want = []
    for i, q in zip(all_ids, all_v, strict=True):
        if i % 100 == 0:
            pairs = sorted((-cut(sum(a * b for a, b in zip(q, x, strict=True))), j) for j, x in zip(all_ids, all_v, strict=True) if j != i)
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(pairs[:10])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pages_avoid_scores():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 16)) * 3
    v = np.floor(1024 * (centres[rng.integers(0, 16, 1000)] + rng.normal(size=(1000, 16)) * 0.2))
    top = float((v * v).sum(1).max())
    cards = pa.StructArray.from_arrays([pa.array(np.arange(1000)), topk._lists(v), pa.array(topk._distances(topk._augmented(v, top), topk._augmented(v[:1], top))[:, 0])], ["vec_id", "v", "far"])
    batch = pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array([0], pa.int32()), pa.ListArray.from_arrays(pa.array([0, 1000], pa.int32()), cards)], names=["page", "root", "cards"])
    built = next(topk._build(v[:1], top)([batch]))
    page = topk._Page({c: built.column(c)[0].as_py() for c in topk.BINARY}, top)
    found, computed = page.search(v[:50], np.arange(50), [None] * 50, 10)
    assert [found[i] for i in range(50)] == [sorted((-int(v[i] @ v[j]), j) for j in range(1000) if j != i)[:10] for i in range(50)]
    print(f"share of scores avoided: {1 - computed / 50_000:.2f}")
    assert computed < 25_000


def test_urls(spark):
    urls = ["http://A.Example.com/en/71?x", "https://x.org/es/1#a", "ftp://example.net/de/8", "http://q.net/de/9", "no scheme", None, "http://com/en/", "http://notexample.com/en/7", "http://cheappills.net/fr/1"]
    html = "<p>cheap pills cheap pills house house garden</p>"
    rows = [(i, u, html, 1) for i, u in enumerate(urls)]
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host int"), RULES).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == ["example.com/en/7", "org/es/", "example.net/de/8", "net/de/", None, None, "com/en/", "com/en/", None]
    assert (got[0]["host"], got[0]["path"], got[1]["path"], got[4]["host"], got[5]["path"]) == ("a.example.com", "/en/71", "/es/1", "", "")
    assert all(r["verdict"] in ("allow", "block") for r in got.values())


def naive_verdicts(urls, htmls):
    """Rules, then words of hosts by the cheapest split, then two products of smoothed shares."""
    split = lambda pattern, text: [x for x in re.split(pattern, text) if x]
    letters = r"[\W\d_]+"
    counts: dict = {}
    for h in htmls:
        for w in split(letters, re.sub("<[^>]*>", " ", h or "").lower()):
            if 2 <= len(w) <= 63:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())

    def cheapest(name):
        best = {0: (0.0, ())}
        for end in range(1, len(name) + 1):
            options = [(best[s][0] + math.log(total / counts[name[s:end]]), s, name[s:end]) for s in range(end) if name[s:end] in counts]
            options.append((best[end - 1][0] + math.log(total) + 10, end - 1, name[end - 1 : end]))
            cost, start, word = min(options)
            best[end] = cost, (*best[start][1], word)
        return best[len(name)][1]

    cases = []
    for u in urls:
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        said = [(len(r), v) for r, v in RULES if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
        tokens = [w for n in split(letters, host) for w in (cheapest(n) if len(n) <= 63 else [n])]
        tokens += ["/" + t for t in split(r"[^a-zü0]+", re.sub("[0-9]+", "0", path).lower())]
        cases.append((max(said)[1] if said else None, tokens))
    seen = {v: [t for s, ts in cases if s == v for t in ts] for v in ("allow", "block")}
    size = len({t for _, ts in cases for t in ts})
    n = {v: sum(s == v for s, _ in cases) for v in seen}
    score = lambda ts, v: math.log(n[v]) + sum(math.log((seen[v].count(t) + 1) / (len(seen[v]) + size)) for t in ts)
    return [s or ("block" if score(ts, "block") - score(ts, "allow") > 1e-9 else "allow") for s, ts in cases]


def test_verdicts_by_brute_force(spark):
    rng = random.Random(12)
    words = ["cheap", "pills", "casino", "bonus", "house", "garden", "recipe", "cook", "gewinnspielteilnahmebedingungen", "kochen", "über"]
    bad, good = words[:4] + [words[8]], words[4:8] + words[9:]
    html = [" ".join(rng.choice(words) for _ in range(20)) + "<p class='x'>casino</p>" for _ in range(60)]
    urls = []
    for i in range(60):
        kind = i % 3
        own = bad if kind == 0 else good if kind == 1 else words
        name = "".join(rng.choice(own) for _ in range(2)) + rng.choice(["", "zq", "9"])
        ending = ("com", "net", rng.choice(["info", "shop"]))[kind]
        path = ("/en/", "/de/", "/")[kind] + rng.choice(own) + rng.choice(["/12", "", "?q=casino", "#top"])
        urls.append(f"https://{rng.choice(['', 'www.'])}{name.title()}.{ending}{path}")
    urls += [None, "", "no scheme", "http://" + "q" * 70 + ".info/casino", "http://casinobonus.info", urls[2], urls[2]]
    html += [None] * 7
    docs = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(docs, RULES).collect()}
    want = naive_verdicts(urls, html)
    assert set(want) == {"allow", "block"} and [got[i] for i in range(len(urls))] == want


def test_segments_with_one_hash_are_told_apart(monkeypatch):
    from gatewise.llm import textkit
    from gatewise.llm.segments import SegmentEncoder

    monkeypatch.setattr(textkit, "span_hashes", lambda data, starts, ends, salt=0: ((ends - starts) % 3).astype(np.uint64))  # a poor one
    asked = []

    def encode(pieces):
        asked.append(len(pieces))
        return [np.frombuffer(p, np.uint8).astype(np.int32) for p in pieces]

    encoder = SegmentEncoder(encode, lambda data: data == 32)
    for texts in (["one two six", "", " ten  two", "x" * 100 + " " + "y" * 100], ["six one " + "y" * 100 + " two"]):
        raw = "".join(texts).encode()
        off = np.cumsum([0, *map(len, texts)])
        ids, first = encoder.block(off, np.frombuffer(raw, np.uint8))
        assert bytes(ids.tolist()) == raw and first.tolist() == off.tolist()
    assert len(encoder.hashes) == 3 and len(asked) >= 3


def test_near_duplicates_of_rows_without_id_and_of_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(4, text), (4, text), (None, text), (2, text + " end"), (2, other), (9, other), (None, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 0, False) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, words=5).collect()), key=str)
    want = [(4, 56, 2, False)] * 2 + [(None, 56, None, True), (2, 57, 2, True), (2, 56, 2, True), (9, 56, 2, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    docs = frame(spark, [])
    for out in (near_duplicates(docs), remove_repeats(docs), remove_repeated_bytes(docs), quality_rules(docs), shard_documents(docs), mix_sources(docs, LEVELS), encode_pieces(docs, PIECE_MODEL), read_token_files(*write_token_files(docs, BYTE_BPE))):
        assert out.count() == 0
    assert top_inner_products(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_pairs_are_confirmed_in_bounded_parts(monkeypatch):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = [(i, i + 100, t, t if i % 3 else t[: len(t) // 2]) for i, t in enumerate(base)] + [(90, 190, None, "a b"), (91, 191, "x " * 3000, "x " * 3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["a", "b", "text_a", "text_b"])
    whole = pa.Table.from_batches(near_dup._confirm(5, 80)(iter([batch]))).to_pylist()
    assert {"a": 1, "b": 101} in whole and {"a": 91, "b": 191} in whole and len(whole) < len(rows)
    monkeypatch.setattr(near_dup, "PAIR_BYTES", 500)
    monkeypatch.setattr(near_dup, "PAIRS", 3)
    spans = list(near_dup._pair_spans(batch))
    assert sum(n for _, n in spans) == len(rows) and max(n for _, n in spans) <= 3 and (len(rows) - 1, 1) in spans
    assert pa.Table.from_batches(near_dup._confirm(5, 80)(iter([batch]))).to_pylist() == whole
    assert not list(near_dup._pair_spans(batch.slice(0, 0)))


def test_token_files_with_an_end_id_over_two_bytes(spark):
    docs = frame(spark)
    short, wide = (sorted(read_token_files(*write_token_files(docs, BYTE_BPE, end_id=end)).collect()) for end in (2, 70000))
    assert [r["n_tokens"] for r in short] == [r["n_tokens"] for r in wide]
    uri, parts = write_token_files(docs, BYTE_BPE, end_id=70000)
    for part in (r["part"] for r in parts.where("docs > 0").collect()):
        assert read_record(uri, part, 0)[1][-1] == 70000
