"""A corpus pipeline of five stages over ``documents``.

Each stage works on what the one before kept: documents that the quality rules
reject go; of each class of near duplicates the smallest doc_id stays; repeated
word windows are cut out of the texts; sources are mixed to target weights, a
document being repeated for each epoch that takes it; the texts are encoded as
SentencePiece ids. All but the last return the columns of ``documents``.

Every row is a document of its own: rows that repeat a doc_id or have none are
judged by their own text, and stages map results back by row, not by doc_id.
Stages read and return the five columns of ``documents``; others are left out, whatever their names.
An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.llm.mixing import mix_sources
from gatewise.llm.near_dup import near_duplicates
from gatewise.llm.pieces import encode_pieces
from gatewise.llm.quality import quality_rules
from gatewise.llm.queries import EPOCHS, LEVELS, PIECE_MODEL, SEED, WEIGHTS
from gatewise.llm.scratch import materialize, temporary
from gatewise.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and ``_row``, a number for each row that ascends with doc_id.

    That is doc_id itself if every row has one of its own. Else rows are numbered and written once: those that repeat
    a doc_id are ordered by their text and other columns, those without one come last.
    The last column of the order only parts rows that are equal in all others.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), *[F.col(c).asc() for c in [*COLUMNS[2:], "_any"]]]
    dealt = docs.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.drop("_any").withColumn("_row", F.monotonically_increasing_id()), "numbered")


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` as the operators take documents: the row's number is its id."""
    return rows.drop("doc_id").withColumnRenamed("_row", "doc_id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on the text and on their source.

    Null and empty texts fail; rows that repeat a doc_id or have none pass or fail each by itself; a null source is a source of its own.
    """
    rows = _numbered(docs)
    kept = quality_rules(_judged(rows)).where("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five words, similarity 0.8.

    The row of the smallest doc_id stays, of equal ones that of the least text hash, one without doc_id last. Null, empty and wordless texts stay.
    """
    rows = _numbered(docs)
    gone = near_duplicates(_judged(rows), words=5, percent=80).where("NOT kept").select(F.col("doc_id").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat a smaller document's window of 50; a text that loses nothing stays as it is.

    A text that loses words has the others joined by one space, and their number of characters; one that loses all becomes empty. Rows
    of one doc_id, and those without one, count as documents in the order of ``near_dedup``. Null texts stay null.
    """
    rows = _numbered(docs).select(F.col("_row").alias("doc_id"), "text", *[F.col(c).alias(f"own_{c}") for c in COLUMNS if c != "text"])
    carry = tuple(c for c in rows.columns if c != "doc_id")
    cut = remove_repeats(rows, window=50, carry=carry)
    own = {c: F.col(f"_carried_{c}" if c == "text" else f"_carried_own_{c}") for c in COLUMNS}
    lost = F.col("n_removed") > 0
    own |= {"text": F.when(lost, F.col("kept_text")).otherwise(own["text"]), "n_chars": F.when(lost, F.length("kept_text").cast("long")).otherwise(own["n_chars"])}
    return cut.select(*[own[c].alias(c) for c in COLUMNS])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them.

    Rows without words are taken in whole epochs alone; a source that isn't named "src" and a number is in a domain of its own.
    """
    rows = _numbered(docs)
    taken = mix_sources(rows, LEVELS, weights=WEIGHTS, max_epochs=EPOCHS, seed=SEED, row="_row").where("epochs > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("epoch"))
    return rows.join(taken, "_row").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the checksum of what they decode to; null and empty texts have no ids."""
    return encode_pieces(docs, PIECE_MODEL)


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("source mixing", mixing), ("sentencepiece", encoding)]

#: The last stage (a tokenizer's ids) can't be said in SQL; ``tests/llm/test_pipeline.py`` compares all five with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written in the shared folder and read again, and its intermediate tables are deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary(spark) as delete:
            docs = stage(spark, docs, sf_dir)
        docs = materialize(docs, name.replace(" ", "-"))
        delete()
    return docs
