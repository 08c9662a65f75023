"""Registered queries: thin bindings of the operators to the given tables."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscope.llm import (
    alignment,
    bpe,
    chat,
    decontaminate,
    line_dedup,
    minhash,
    quality,
    secret_scan,
    simhash,
    substring,
    token_counts,
    url_filter,
    whitening,
)
from flockscope.llm.common import read_table


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; ``FLOCKSCOPE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("FLOCKSCOPE_TOKENIZERS")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, *token_counts.read_pieces(tokenizer_path("piece_bpe_32k.model")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, read_table(spark, sf_dir, "labels"))
    return out.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "llr")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark))
    return out.select("_row.page_id", "host", "path", "rule", "verdict")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = secret_scan.scan(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select("_row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
                      secret_scan.written(F.concat("base", "added")).alias("spans"), "n_live", "n_copied")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.remove_repeats(docs, window=13)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def encoded(docs: DataFrame) -> DataFrame:
    """The digest columns of the BPE operator's ids and decoded texts."""
    out = bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicate_groups(docs, shingle=3, radius=2)
    return out.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fingerprint_value")).alias("fingerprint"),
                      "component_id")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair."""
    turns = read_table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")
    return chat.preference_turns(turns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_run=2, long_line=12)
    return out.select("_row.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_leaks(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   read_table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", decontaminate.rounded(F.col("similarity")).alias("similarity"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = minhash.near_duplicates(docs, shingle=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_url_filters, op4_secret_scans,
                                   op5_substring_dedup, op6_bpe, op7_simhash, op8_chat_formatting, op9_line_dedup,
                                   op10_decontamination, op11_embedding_whitening,
                                   op12_tokenizer_alignment, op13_minhash)}
