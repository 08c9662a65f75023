"""Sources S1-S9: every reader takes an explicit schema; ids are try_cast to LONG."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import scrub_nul
from . import schemas


def load_schema(path_or_json: str | dict) -> T.StructType:
    """StructType from a JSON file path, a JSON string or a dict."""
    if isinstance(path_or_json, dict):
        return T.StructType.fromJson(path_or_json)
    text = path_or_json
    if not text.lstrip().startswith("{"):
        with open(path_or_json) as fh:
            text = fh.read()
    return T.StructType.fromJson(json.loads(text))


def _checked(raw: DataFrame, bad: Column, metrics: Observation | None) -> DataFrame:
    """The rows that are not ``bad``. ``metrics`` gets ``n_rows`` and ``n_rejected`` of the same scan.

    The numbers are there once an action has read the result
    (``metrics.get``); a limit above it stops the scan and the count with it.
    """
    if metrics is not None:
        raw = raw.observe(metrics, F.count(F.lit(1)).alias("n_rows"), F.count(F.when(bad, 1)).alias("n_rejected"))
    return raw.where(~bad)


def read_tweets(spark: SparkSession, glob: str, schema: T.StructType | None = None,
                metrics: Observation | None = None) -> DataFrame:
    """JSON-lines tweets under an explicit nested schema (codec from extension).

    A line that is no JSON object of the schema gives a row of what could be
    read, as Spark does; with ``metrics`` such lines are counted and left out.
    """
    fields = schema or schemas.TWEET
    if metrics is None:
        return spark.read.schema(fields).json(glob)
    broken = "_corrupt_record"
    raw = spark.read.schema(T.StructType([*fields, T.StructField(broken, T.StringType())])).json(glob)
    return _checked(raw, F.col(broken).isNotNull(), metrics).drop(broken)


def _typed(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in casts.items()])


def _missing(casts: dict[str, str], required: tuple[str, ...]) -> Column:
    """A required column is missing or no number of its type."""
    return reduce(or_, [F.expr(f"try_cast(`{c}` AS {casts[c]})").isNull() for c in required])


INFLUENCER_CASTS = {"uid": "BIGINT", "grp": "INT"}
EDGE_CASTS = {"source": "BIGINT", "target": "BIGINT", "attr": "INT"}


def _raw_influencers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INFLUENCERS_RAW).option("sep", " ").option("header", True).csv(path)


def _raw_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EDGES_RAW).option("header", True).csv(path)


def malformed_influencers(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an S2 file that ``read_influencers`` rejects (to store them; to count them use ``metrics``)."""
    return _raw_influencers(spark, path).where(_missing(INFLUENCER_CASTS, ("uid",)))


def malformed_edges(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an S3 file that ``read_edges`` rejects."""
    return _raw_edges(spark, path).where(_missing(EDGE_CASTS, ("source", "target")))


def read_influencers(spark: SparkSession, path: str, metrics: Observation | None = None) -> DataFrame:
    """Space-separated (uid, grp) with header; rows with a malformed id are dropped and counted."""
    return _typed(_checked(_raw_influencers(spark, path), _missing(INFLUENCER_CASTS, ("uid",)), metrics), INFLUENCER_CASTS)


def read_edges(spark: SparkSession, path: str, metrics: Observation | None = None) -> DataFrame:
    """S3: comma CSV (source, target, attr) with header; rows without both ids are dropped and counted."""
    return _typed(_checked(_raw_edges(spark, path), _missing(EDGE_CASTS, ("source", "target")), metrics), EDGE_CASTS)


def read_parquet_text_clean(spark: SparkSession, path: str, text_cols: list[str] | None = None) -> DataFrame:
    """One Parquet scan over a glob; NUL characters removed from text columns."""
    df = spark.read.parquet(path)
    cols = text_cols if text_cols is not None else [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: scrub_nul(c) for c in cols}) if cols else df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, pos)``: the lines of a file, or of a folder's files by name, numbered from 1.

    A split's lines are numbered in the scan; the splits' first numbers are sums
    over one row per split (a 128 MB piece of a file), the only rows shuffled.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mark"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (lines.groupBy("file", "block").agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("n"))
              .select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    return lines.join(splits, ["file", "block"]).select("value", (F.col("mark") - F.col("first") + F.col("ahead") + 1).alias("pos"))


def read_mm_edges(spark: SparkSession, mtx: str, row_ids: str, col_ids: str, metrics: Observation | None = None) -> DataFrame:
    """MatrixMarket coordinate file + line-ordered id files -> (source, target).

    Comment and blank lines are skipped, the first other line is the size line.
    Entries without two numbers, and entries whose line of an id file is absent
    or holds no number, are rejected and counted by ``metrics``.
    """
    lines = numbered_lines(spark, mtx).where(~F.startswith("value", F.lit("%")) & (F.trim("value") != ""))
    size_line = lines.agg(F.min("pos")).scalar()
    parts = F.split(F.trim(F.col("value")), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    entries = lines.where(F.col("pos") > size_line).select(number(0).alias("i"), number(1).alias("j"))
    ids = lambda path, name, at: numbered_lines(spark, path).select(
        F.trim("value").try_cast("long").alias(name), F.col("pos").alias(at))
    found = entries.join(ids(row_ids, "source", "i"), "i", "left").join(ids(col_ids, "target", "j"), "j", "left")
    return _checked(found.select("source", "target"), F.col("source").isNull() | F.col("target").isNull(), metrics)


def read_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
               header: bool = True) -> DataFrame:
    """Delimited table under an explicit schema."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Header-less TSV with embedded NULs turned into spaces; 19 names by position."""
    raw = spark.read.text(path).select(F.translate("value", "\u0000", " ").alias("value"))
    parts = F.split("value", "\t")
    return raw.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(schemas.PANEL_PROFILE_NAMES)])


def read_assignments(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Every ``y_<k>.csv`` under a folder, k taken from the name of the file or of the folder it lies in."""
    df = spark.read.schema(schema or schemas.ASSIGNMENT).option("header", True).csv(path)
    k = F.regexp_extract(F.col("_metadata.file_path"), r".*/y_(\d+)[^/]*(?:/[^/]*)?$", 1)
    return df.withColumn("k", F.when(k != "", k.cast("int")))
