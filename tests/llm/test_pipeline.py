"""The stages of the corpus pipeline on rows with repeated and without doc_ids, against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece
from brute import mixed
from pyspark.sql import functions as F

from gatewise.llm.queries import PIECE_MODEL, WEIGHTS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(11)
    prose = lambda n: " ".join(f"{rng.choice('bcdfgh')}{rng.randrange(10**6)}" for _ in range(n))
    base, passage, other = prose(120), prose(60), prose(90)
    texts = [(i, prose(80 + i)) for i in range(20)]
    texts += [(50, base), (50, base), (None, base), (60, base + " end"), (None, prose(100)), (None, prose(100)), (None, "short"), (None, None)]
    texts += [(70, "bad"), (70, other), (71, other), (71, prose(55))]  # a rejected row shares its doc_id with a good one
    texts += [(30, prose(60) + " " + passage), (80, prose(70) + " " + passage), (80, passage + " " + prose(75)), (None, prose(62) + " " + passage)]
    return [(i, t, ("en", "de", None)[k % 3], f"src{k % 2}", len(t or "")) for k, (i, t) in enumerate(texts)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def same(got, want):
    assert Counter(map(tuple, got.collect())) == Counter(want)


def good(data):
    """Rows whose text passes; fewer than half of each source fail here, so none is lost by its source."""
    return [r for r in data if len(WORD.findall(r[1] or "")) >= 50]


def ordered(data):
    return sorted(data, key=lambda r: (r[0] is None, r[0] or 0))


def one_of_each(data):
    """Classes by links, as lists of rows in the order in which the first is kept."""
    sets = []
    for r in data:
        w = WORD.findall((r[1] or "").lower())
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if sets[i] != {()} and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    return [r for i, r in enumerate(data) if root[i] == i or i == min(j for j, x in enumerate(root) if x == root[i])]


def cut(data):
    words = [tuple(WORD.findall(r[1] or "")) for r in data]
    seen: dict = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            seen.setdefault(w[p : p + 50], i)
    out = []
    for i, (r, w) in enumerate(zip(data, words, strict=True)):
        gone = {q for p in range(len(w) - 49) if seen[w[p : p + 50]] < i for q in range(p, p + 50)}
        text = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((r[0], text, *r[2:4], len(text)) if gone else r)
    return out


def test_quality_judges_each_row(spark):
    same(corpus_pipeline.quality(spark, frame(spark, rows()), ""), good(rows()))


def test_near_dedup_keeps_one_row_of_a_class(spark):
    data = [(i, t, "en", "src0", len(t or "")) for i, t, *_ in rows()]
    want = one_of_each(ordered(data))
    assert len(want) < len(data) - 3
    same(corpus_pipeline.near_dedup(spark, frame(spark, data), ""), want)


def test_substring_dedup_keeps_each_row_once(spark):
    data = [r for r in rows() if r[1] is None or r[0] not in (50, 60, 70, 71)]
    got = corpus_pipeline.substring_dedup(spark, frame(spark, data), "").collect()
    assert len(got) == len(data)
    passage = next(r[1] for r in data if r[0] == 30).split(" ")[60:]
    holders = [r for r in got if r["text"] and passage[30] in r["text"].split(" ")]
    assert [r["doc_id"] for r in holders] == [30]  # cut from both versions of 80 and from the row without doc_id
    texts = [r["text"] for r in got if r["doc_id"] == 80]
    assert sorted(len(t.split(" ")) for t in texts) == [70, 75] and all(r["n_chars"] == len(r["text"]) for r in got if r["text"])
    same(corpus_pipeline.substring_dedup(spark, frame(spark, data), ""), cut(ordered(data)))


@pytest.mark.parametrize("repeat", [True, False])
def test_mixing_takes_each_row_by_its_epochs(spark, repeat):
    data = [(None if i % 4 == 0 else i // 3 if repeat else i, f"w{i} " * 10, "en", "src1", 40 + i) for i in range(60)]
    got = Counter(map(tuple, corpus_pipeline.mixing(spark, frame(spark, data), "").collect()))
    # one leaf whose budget is one epoch of all its words: every row is taken once
    assert got == Counter(data)


def test_mixing_keeps_budgets(spark):
    data = [(None if i % 5 == 0 else i // 2, f"w{i} " * 10, "en", f"src{0 if i < 150 else 1}", 0) for i in range(200)]
    got = Counter(map(tuple, corpus_pipeline.mixing(spark, frame(spark, data), "").collect()))
    taken = Counter()
    for r, n in got.items():
        taken[r[3]] += 10 * n
    # src0 (weight 2) has a target of 1333 of 2000 tokens, src1 one of 667
    assert set(got) <= set(data) and taken["src0"] in range(1320, 1341) and taken["src1"] in range(650, 671)
    assert max(got.values()) <= 2


def taken(data):
    """How often each (doc_id, words) of a source's rows is taken, by brute force."""
    paths = [(f"d{int(r[3][3:]) % 4}" if r[3] and r[3][3:].isdigit() else "other", r[2] or "", r[3] or "") for r in data]
    sizes = [len(WORD.findall(r[1] or "")) for r in data]
    _, times = mixed([r[0] for r in data], paths, sizes, WEIGHTS, 1.0)
    out = Counter()
    for r, n, t in zip(data, sizes, times, strict=True):
        out[r[0], n] += t
    return +out


def test_mixing_by_brute_force(spark):
    data = [(None if i % 9 == 0 else i, f"w{i} " * (5 + i * 7 % 40), ("en", "de", None)[i % 3], ("src0", "src4", "src1", "web", None)[i % 5], i) for i in range(120)]
    got = Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in corpus_pipeline.mixing(spark, frame(spark, data), "").collect())
    assert got == taken(data) and max(got.values()) > 1


def test_run(spark, tmp_path):
    frame(spark, rows()).withColumn("epoch", F.lit("x")).withColumn("kept_text", F.lit(1)).withColumn("_row", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    left = cut(one_of_each(ordered(good(rows()))))
    of = {tuple(model.encode(r[1])): r for r in left}
    assert all(r["round_trip"] for r in got)
    assert Counter((r["doc_id"], len(WORD.findall(of[tuple(r["ids"])][1]))) for r in got) == taken(left)


def test_run_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
