"""Quality rules of documents and of their hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: White space that parts words: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def _with_repeated_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words of ``_words`` in three-word windows that are found twice or more.

    The windows are sorted with their places, so equal ones stand side by side; from
    the places of those, each adds the words that the place before hasn't covered.
    Every step is a column of its own: a lambda would evaluate a captured expression anew
    for each element.
    """
    word = lambda i: F.get("_words", i)
    at = F.sequence(F.lit(0), F.size("_words") - 3)
    windows = F.transform(at, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    df = df.withColumn("_windows", F.when(F.size("_words") >= 3, windows))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    found = F.transform("_sorted", lambda w, j: F.when((F.get("_sorted", j - 1)["h"] == w["h"]) | (F.get("_sorted", j + 1)["h"] == w["h"]), w["i"]))
    df = df.withColumn("_places", F.sort_array(F.filter(found, lambda i: i.isNotNull())))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_places", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_windows", "_sorted", "_places")


def document_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of each text and base_failed; ``text`` is left out."""
    others = [c for c in docs.columns if c != "text"]
    out = docs.select(*others, F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = out.withColumn("_words", words_of(F.col("text"))).withColumn("_lines", lines)
    out = _with_repeated_words(out).select(
        *others,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def quality_rules(docs: DataFrame, host: str = "source", least_rate: float = 0.5) -> DataFrame:
    """Judge documents by rules on the text and by the failure rate of their host.

    The rate of each host (values of ``host``) is shrunk towards the mean by a beta prior
    that is fitted to all hosts' rates by their moments; a host whose shrunk rate is over
    ``least_rate`` loses all of its documents. Rows with a null host are one host.
    Returns (doc_id, ``host``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, host_rate, kept), a row for each row of ``docs``; null texts count as
    empty, and so fail; a null doc_id is kept as it is. Other columns are ignored. An
    empty table gives an empty result. Host totals are summed before they are shuffled.
    """
    judged = docs.select("doc_id", F.col(host).cast("string").alias("_host"), "text")
    stats = materialize(document_rules(judged), "document-rules")
    failures = F.sum(F.when(F.col("base_failed"), 1).otherwise(0))
    hosts = materialize(stats.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), failures.alias("failed")), "hosts")
    rate = F.col("failed") / F.col("n")
    m = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("var")).first()
    mean = min(max(m["mean"] if m["mean"] is not None else 0.5, 1e-6), 1 - 1e-6)
    strength = mean * (1 - mean) / m["var"] - 1 if m["var"] else 1e6
    strength = min(max(strength, 1.0), 1e6)  # at least the weight of one document
    shrunk = hosts.select("_host", ((F.col("failed") + mean * strength) / (F.col("n") + strength)).alias("host_rate"))
    out = stats.join(shrunk, stats["_host"].eqNullSafe(shrunk["_host"])).select(
        "doc_id", stats["_host"].alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate"
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= least_rate))
