"""URL filter: rules first, then naive Bayes over segmented host and path words."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Longest label of a host name (a rule of the domain name system), and so the longest word that one is split into.
LONGEST = 63
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are ("host/path", verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _viterbi(total: int):
    """(name, found: list of (start, size, count)) -> the most likely split into words, letters that no word covers one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, splits = batch.column(0).to_pylist(), []
            for name, found in zip(names, batch.column(1).to_pylist(), strict=True):
                best = [(0.0, 0)] + [(math.inf, 0)] * len(name)
                by_end: dict[int, list[tuple[int, float]]] = {}
                for x in found or []:
                    by_end.setdefault(x["start"] + x["size"], []).append((x["start"], math.log(total / x["n"])))
                for end in range(1, len(name) + 1):
                    unknown = (end - 1, math.log(total) + 10)
                    best[end] = min((best[s][0] + cost, s) for s, cost in [*sorted(by_end.get(end, [])), unknown])
                words, end = [], len(name)
                while end:
                    words.append(name[best[end][1] : end])
                    end = best[end][1]
                splits.append(words[::-1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(splits, pa.list_(pa.string()))], names=["name", "words"])

    return run


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) over all texts: lower-case runs of two and more letters, no longer than a label; tags of HTML are left out."""
    plain = F.regexp_replace(F.coalesce(column, F.lit("")), "<[^>]*>", " ")
    words = F.explode(F.split(F.lower(plain), r"[^\p{L}]+"))
    return texts.select(words.alias("word")).where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for distinct ``names``: split by the unigram ``counts``.

    The substrings of the names are joined with the counts, so that the dictionary, which
    grows with the corpus, isn't sent to every task. A name of more than ``LONGEST`` letters is
    no valid label and stays one word.
    """
    counts = materialize(counts, "word-counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 1
    names = materialize(names.select("name").distinct(), "names")
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start")).where(F.length("name").between(1, LONGEST))
    parts = starts.select("name", (F.col("start") - 1).alias("start"), F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("start") + 1))).alias("size"))
    parts = parts.withColumn("word", F.substr("name", F.col("start") + 1, F.col("size")))
    found = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("start", "size", "n")).alias("found"))
    split = names.where(F.length("name") <= LONGEST).join(found, "name", "left").select("name", "found").mapInArrow(_viterbi(total), "name string, words array<string>")
    return split.unionByName(names.where(F.length("name") > LONGEST).select("name", F.array("name").alias("words")))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], corpus: DataFrame | None = None, column: str = "html") -> DataFrame:
    """Verdict on every url: (page_id, host, path, rule, verdict), a row for each row of ``pages``.

    The longest fitting rule decides. Other urls are judged by multinomial naive Bayes on the
    words of host and path: names between dots, hyphens and digits are split by the unigram
    counts of ``corpus`` (default: ``column`` of ``pages``), runs of digits in paths count as "0". The classes'
    counts come from all urls that a rule decides; with one class alone there, the others get "allow";
    equal scores get "allow". Null urls and urls without ``://`` have an empty host and path, and are judged
    likewise. Repeated rows are judged and counted as often as they occur; other columns are ignored.
    Urls that differ in digits of the path alone are scored once.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("said", said).withColumn("shape", F.regexp_replace("path", "[0-9]+", "0"))
    urls = materialize(urls, "urls")
    shapes = materialize(urls.groupBy("host", "shape").agg(*[F.sum(F.when(F.col("said") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")]), "shapes")
    names = F.filter(F.split("host", r"[^\p{L}]+"), lambda x: x != "")
    split = segment_names(shapes.select(F.explode(names).alias("name")), word_counts(pages if corpus is None else corpus, column))
    split = materialize(split, "split-names")
    tokens = shapes.select("host", "shape", "allow", "block", F.explode(names).alias("name")).join(split, "name").select("host", "shape", "allow", "block", F.explode("words").alias("token"))
    in_path = F.filter(F.split(F.lower("shape"), r"[^\p{L}0]+"), lambda x: x != "")
    tokens = materialize(tokens.unionByName(shapes.select("host", "shape", "allow", "block", F.explode(F.transform(in_path, lambda t: F.concat(F.lit("/"), t))).alias("token"))), "url-tokens")
    seen = materialize(tokens.groupBy("token").agg(F.sum("allow").alias("a"), F.sum("block").alias("b")), "token-classes")
    sums = seen.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("v")).first()
    n = urls.agg(F.count_if(F.col("said") == "allow").alias("a"), F.count_if(F.col("said") == "block").alias("b")).first()
    if n["a"] and n["b"]:
        weight = F.log((F.col("b") + 1) / F.lit(float(sums["b"] + sums["v"]))) - F.log((F.col("a") + 1) / F.lit(float(sums["a"] + sums["v"])))
        score = tokens.join(seen.select("token", weight.alias("weight")), "token").groupBy("host", "shape").agg(F.sum("weight").alias("score"))
        judged = F.when(F.coalesce("score", F.lit(0.0)) + math.log(n["b"] / n["a"]) > 1e-9, "block").otherwise("allow")
        urls = urls.join(materialize(score, "url-scores"), ["host", "shape"], "left")
    else:
        judged = F.lit("allow")
    return urls.select("page_id", "host", "path", "rule", F.coalesce("said", judged).alias("verdict"))
