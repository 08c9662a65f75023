"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination, BPE.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and calls one operator of
``flockscope.llm``; its result is written as Parquet and reread as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscope.llm import decontaminate, line_dedup, quality, simhash
from flockscope.llm.common import BLANKS, read_table, write_shared
from flockscope.llm.queries import encoded
from flockscope.session import prepare_session

#: BPE ids cannot be expressed in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    prepare_session(spark)
    return quality.judge(docs, read_table(spark, sf_dir, "labels")).where("kept").select("_row.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of two lines, and lines of 12 words or more, are cut out of ``text``; ``n_chars`` follows.

    A document of which nothing but blanks is left was a copy of earlier lines
    throughout, and goes.
    """
    prepare_session(spark)
    out = line_dedup.dedup_lines(docs, min_run=2, long_line=12)
    out = out.where((F.col("n_removed") == 0) | (F.btrim("kept_text", F.lit(BLANKS)) != ""))
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        count = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, count).otherwise(F.col("_row.n_chars"))
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    prepare_session(spark)
    return simhash.keep_representatives(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    prepare_session(spark)
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every remaining document."""
    prepare_session(spark)
    return encoded(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_deduplication), ("simhash_near_dedup", near_dedup),
          ("benchmark_decontamination", decontamination), ("bpe_encoding", bpe_encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
