"""The queries over the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .licences import PHRASES, scan_licences, templates, words_of
from .mixing import mix_sources
from .near_dup import near_duplicates
from .pieces import encode_pieces
from .quality import quality_rules
from .quality import words_of as words_column
from .runs import periodic_runs
from .scratch import materialize
from .sharding import SALTS, shard_documents
from .substrings import remove_repeats
from .suffixes import remove_repeated_bytes
from .token_files import read_token_files, write_token_files
from .topk import top_inner_products
from .tries import prefix_trie, sequences
from .urls import LONGEST, filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Public tokenizer files, at the same place on all machines.
PIECE_MODEL, BYTE_BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, parts = write_token_files(_table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)
    return read_token_files(uri, parts)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"), window=50, with_text=False).drop("kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), window=50, with_text=False).drop("kept_text")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"), k=10, every=100)


#: Tree of the documents: four domains of sources (and one of sources without a number), their languages, their sources.
LEVELS = {"domain": "coalesce('d' || CAST(try_cast(substring(source, 4) AS INT) % 4 AS STRING), 'other')", "lang": "lang", "source": "source"}
WEIGHTS = {"domain=d0": 2, "lang=en": 3}
EPOCHS, SEED = 2, 17


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), LEVELS, budget_share=1.0, weights=WEIGHTS, max_epochs=EPOCHS, seed=SEED)


def op8_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("source", "host_rate")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), PIECE_MODEL, with_ids=False).drop("ids")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text (by the crc32 h of doc_id) periodic from word a = h // 10 % n on, its words joined by one space."""
    h, n, at = F.crc32(F.col("doc_id").cast("string")), F.size("_words"), lambda i: F.get("_words", i.cast("int"))
    out = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), words_column(F.col("text"))).alias("_words"))
    out = out.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    out = out.withColumn("_tail", F.transform(F.sequence(F.lit(0).cast("long"), n - F.col("_a") - 1), lambda i: at(F.col("_a") + i % F.col("_p"))))
    periodic = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), "_tail"), " ")
    return out.select("doc_id", F.when(n > 0, periodic).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents")), with_text=False)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


RAREST, LEAST_SHARE = 8, 0.6


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents"), rarest=RAREST, least=LEAST_SHARE)


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations whose first turns, by the crc32 of conv_id 0 to 3 of them, are those of the conversation at the last multiple of 20."""
    own = materialize(own, "turns")
    h, base = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int"), F.col("conv_id") - F.col("conv_id") % 20
    heads = own.where(base == F.col("conv_id")).select(F.col("conv_id").alias("_base"), *[F.slice(c, 1, 3).alias(f"_{c}") for c in ("keys", "words")])
    kinds = dict(own.dtypes)
    joined = lambda c: F.concat(F.slice(F.coalesce(f"_{c}", F.array().cast(kinds[c])), F.lit(1), h), F.slice(c, h + 1, F.size(c)))
    return own.join(heads, base == F.col("_base"), "left").select("conv_id", joined("keys").alias("keys"), joined("words").alias("words"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(sequences(_table(spark, sf_dir, "conversations"), rebuilt))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash_near_dedup,
        op2_url_filter,
        op3_token_files,
        op4_suffix_dedup,
        op5_substring_dedup,
        op6_exact_top_k,
        op7_source_mixing,
        op8_minimax_sharding,
        op9_host_quality,
        op10_sentencepiece,
        op11_periodic_runs,
        op12_licence_scan,
        op13_conversation_trie,
        pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """op3's and op10's ids and the pipeline can't be said in SQL; their tests compare them with the libraries and brute force."""
    return {
        "op1_minhash_near_dedup": oracles.OP1,
        "op2_url_filter": oracles.op2(RULES, LONGEST),
        "op4_suffix_dedup": oracles.OP4,
        "op5_substring_dedup": oracles.OP5,
        "op6_exact_top_k": oracles.OP6,
        "op7_source_mixing": oracles.op7(LEVELS, WEIGHTS, EPOCHS, SEED),
        "op8_minimax_sharding": oracles.op8(16, SALTS),
        "op9_host_quality": oracles.OP9,
        "op11_periodic_runs": oracles.OP11,
        "op12_licence_scan": oracles.op12([(t.label, t.words, t.keys) for t in templates()], [(words_of(p), label) for p, label in PHRASES], RAREST, LEAST_SHARE),
        "op13_conversation_trie": oracles.OP13,
    }
