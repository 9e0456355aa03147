"""Periodic runs, the licence scan and the conversation trie against brute force, on odd rows and cut into blocks."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gatewise.llm import licences, queries, runs, tries
from gatewise.llm.mixing import leaf_budgets
from gatewise.llm.substrings import remove_repeats
from gatewise.llm.topk import top_inner_products
from tests.llm.test_oracles import same


def brute_runs(w, least):
    """Periods from the smallest on; a stretch that lies within a run of a divisor has that as its period."""
    found = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, 2 * p) and not any(p % q == 0 and s <= i and i + size <= s + n for s, n, q in found):
                found.append((i, size, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = [rng.randint(0, rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(0, 80))]
    if rng.random() < 0.6 and len(w) > 5:
        a = rng.randint(0, len(w) // 2)
        p = rng.randint(1, (len(w) - a) // 2)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = 9
    return w


@pytest.mark.parametrize("probes", [7, 1 << 20])
def test_runs_of_random_words(monkeypatch, probes):
    monkeypatch.setattr(runs, "PROBES", probes)
    monkeypatch.setattr(runs, "CHUNK", max(probes, 16))
    rng = random.Random(probes)
    for _ in range(600):
        docs, least = [random_words(rng) for _ in range(rng.randint(1, 5))], rng.choice([2, 4, 12])
        first = np.concatenate([[0], np.cumsum([len(w) for w in docs])])
        doc, start, size, period = runs.find_runs(np.array(sum(docs, []), np.int64), first, least)
        for d, w in enumerate(docs):
            mine = doc == d
            assert list(zip((start[mine] - first[d]).tolist(), size[mine].tolist(), period[mine].tolist(), strict=True)) == brute_runs(w, least)


def test_runs_of_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one", "a " * 5000, "é ☃ " * 40 + "end", "x y z\n" * 4, "x y z\n" * 4 + "x y", " ".join(map(str, range(500))) + " a b" * 9]
    texts += ["\n ".join(f"w{x}" for x in random_words(rng)) + rng.choice(["", " "]) for _ in range(60)]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, period int")
    got = list(map(tuple, runs.periodic_runs(docs).collect()))
    want = []
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute_runs(w, 12)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        text = " ".join(kept)
        want.append((None if i == 3 else i // 2, len(w), len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, found, hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(), len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    want.sort(key=repr)
    assert sorted([(*g[:7], [tuple(r) for r in g[7]], *g[8:]) for g in got], key=repr) == want
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_words_of_one_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"a b " * 8, np.uint8)
    off = np.array([0, len(data)])
    monkeypatch.setattr(runs.tk, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    rows = runs._block(off, data, 12, True)
    assert rows["runs"] == [[{"start": 0, "length": 16, "period": 2}]] and rows["collapsed"] == ["a b"]


def test_planted_texts(spark):
    texts = [None, "", "a", " ".join(f"v{i}" for i in range(700)), "  two words "]
    docs = spark.createDataFrame([(i if i != 7 else None, texts[i % 5]) for i in range(-60, 200)], "doc_id long, text string")
    changed = 0
    for r in queries.with_planted_runs(docs).collect():
        text = texts[r["doc_id"] % 5] if r["doc_id"] is not None else texts[7 % 5]
        w, h = (text or "").split(), zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text, changed = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n)), changed + 1
        assert r["text"] == text
    assert changed > 5


LONG = "Preface.\n/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including without limitation the rights\n * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell */ the end"


def test_licences(spark, tmp_path):
    texts = [None, "", "?!", "plain words about nothing", "Released under the MIT License.", "MIT\nlicense, mit-LICENSE; smit license", "an Apache License and the General Public License", LONG, LONG.replace("free of charge", "for a charge")]
    texts += ["x " * 3000 + "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0!", "CC BY is nice", "This program: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "ümit license", "the the the of of and or to in " * 50]
    docs = spark.createDataFrame([(None if i == 2 else max(i, 1), t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    by_text = {r["doc_id"]: r for r in licences.scan_licences(docs).collect()}
    assert by_text[7]["labels"] == "mit" and by_text[7]["base_labels"] == "" and by_text[7]["score"] > 0.9 and by_text[8]["labels"] == ""
    assert by_text[9]["labels"] == "cc-by-nc" and by_text[12]["labels"] == "gpl,lgpl"
    assert by_text[5]["n_base"] == 2 and by_text[5]["labels"] == "mit" and (by_text[5]["first_word"], by_text[5]["last_word"]) == (0, 2)
    assert same(spark, "op12_licence_scan", tmp_path) == len(texts)
    assert licences.scan_licences(docs.limit(0)).count() == 0


def brute_trie(convs):
    nodes = {}
    for conv, seq, _ in convs:
        for d in range(len(seq) // 16 + 1):
            nodes.setdefault(seq[: 16 * d], []).append(conv)
    words = {seq[: 16 * d]: w[d - 1] for _, seq, w in convs for d in range(1, len(seq) // 16 + 1)}
    kids = {p: sum(len(q) == len(p) + 16 and q.startswith(p) for q in nodes) for p in nodes}
    out = []
    for p, members in nodes.items():
        sub = [q for q in nodes if q.startswith(p)]
        ends = ",".join(map(str, sorted(c for c, seq, _ in convs if seq == p)))
        out.append((min(members), len(p) // 16, min(nodes[p[:-16]]) if p else None, len(members), kids[p], sum(not kids[q] for q in sub), sum((len(nodes[q]) - 1) * words.get(q, 0) for q in sub), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_convs(rng, n):
    convs, texts = [], [bytes([i]) * 16 for i in range(3)]
    size = {t: i + 1 for i, t in enumerate(texts)}
    for c in rng.sample(range(1000), n):
        seq = [rng.choice(texts[: rng.randint(1, 3)]) for _ in range(rng.choice([0, 1, 2, 3, 7]))] if not convs or rng.random() < 0.6 else [x for x in re.findall(rb"(?s).{16}", rng.choice(convs)[1])][: rng.randint(0, 9)]
        convs.append((c, b"".join(seq), [size[x] for x in seq]))
    return convs


def test_trie_in_blocks(monkeypatch):
    """Blocks cut anywhere, within copies and within prefixes of one another; ids in pieces of one."""
    monkeypatch.setattr(tries, "PIECE", 20)
    rng = random.Random(5)
    for _ in range(400):
        convs = sorted(random_convs(rng, rng.randint(1, 25)), key=lambda c: (c[1], c[0]))
        cuts = sorted(rng.sample(range(len(convs) + 1), min(rng.randint(0, 8), len(convs))))
        rows = [r for b, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(convs)], strict=True)) for r in tries._block(iter([(k, w, c) for c, k, w in convs[i:j]]), b)]
        edges = sorted((r for r in rows if "block" in r), key=lambda r: (r["block"], r["piece"] >= 0, not r.get("at_first"), r["piece"]))
        closed = [r for b in tries._edges(iter([pa.RecordBatch.from_pylist(edges, tries._BLOCKS)])) for r in b.to_pylist()]
        nodes = [r for r in rows if "block" not in r] + [r for r in closed if r["same_as"] is None]
        low = {r["id"]: r["conv_id"] for r in [*nodes, *closed] if r.get("id") is not None}
        got = [(r["conv_id"], r["depth"], low[r["parent_id"]] if r.get("parent_id") is not None else r.get("parent_conv_id"), r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"] or tries.NOTHING) for r in nodes]
        assert sorted(got, key=repr) == brute_trie(convs)


def test_trie_on_spark(spark):
    rng = random.Random(6)
    convs = random_convs(rng, 300)
    got = tries.prefix_trie(spark.createDataFrame([(c, bytearray(k), w, 1) for c, k, w in convs], "conv_id long, key binary, words array<long>, depth int"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(convs)
    assert tries.prefix_trie(got.selectExpr("conv_id", "CAST(NULL AS BINARY) AS key", "CAST(NULL AS ARRAY<BIGINT>) AS words").limit(0)).count() == 0


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", "same words", "other words here", "ü ☃"]
    rows = [(c, t if t else rng.choice([None, 0]), rng.choice(["user", None, ""]), rng.choice(texts), "x") for c in [*range(-45, 90, 3), None, 200, 219, 5000] for t in range(rng.choice([1, 2, 3, 9]))]
    rows += rows[:20]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    assert same(spark, "op13_conversation_trie", tmp_path)
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert queries.op13_conversation_trie(spark, str(tmp_path / "none")).count() == 0


def test_budgets_of_one_parent_in_ranges(spark):
    """A thousand children of one parent, most of equal ratio, over four ranges: shares as running totals give them one by one."""
    rng = random.Random(5)
    tokens = {f"s{i:04d}": rng.choice([0, 1, 1, 1, 7, 500]) for i in range(1000)}
    weights = {n: rng.choice([1, 1, 3]) for n in tokens}
    leaves = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    for budget in (0, 700, 5000, 10**6):
        order = sorted(tokens, key=lambda n: (2 * tokens[n] / weights[n], n))
        left, weight, want = min(budget, 2 * sum(tokens.values())), sum(weights.values()), {}
        while order and left * weights[order[0]] >= 2 * tokens[order[0]] * weight:
            name = order.pop(0)
            want[name] = 2 * tokens[name]
            left, weight = left - want[name], weight - weights[name]
        upto = 0
        for name in order:
            want[name] = left * (upto + weights[name]) // weight - left * upto // weight
            upto += weights[name]
        got = leaf_budgets(leaves, ["source"], budget, {f"source={n}": w for n, w in weights.items()}, 2)
        assert {r["source"]: r["budget"] for r in got.collect()} == want


def test_no_table_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, " ".join(f"w{j % 70}" for j in range(60 + i)), "en", "s", 0) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    assert remove_repeats(docs, window=20).where("n_removed > 0").count() == 7
    assert {t.name for t in spark.catalog.listTables()} == before


def test_top_k_counts_its_work(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(600)]
    done = {}
    got = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, done=done)
    assert got.count() == 60 and set(done) == {"home-hits", "next-hits", "other-hits"}
    assert done["home-hits"][0] == 6 and 0 < sum(s for _, s in done.values()) <= 6 * 600
