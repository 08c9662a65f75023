"""Incremental daily keyword counts with Structured Streaming (A1 over arriving tweet files).

The same projection, broadcast influencer join and keyword flags as the batch
operator, applied to a file stream of JSON tweets. Counts are kept per
(day window, grp, userid, is_rt) in the state store; the watermark on tweet
time closes a day once tweets older than the allowed lateness stop arriving,
and the day's final counts are emitted once (append mode). Written with a
checkpoint location so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import DAY_KEY_FORMAT
from ..operators.counts import keyword_flags, project_tweets, to_long_counts
from ..sources import schemas


def stream_daily_keyword_counts(spark: SparkSession, tweets_dir: str, influencers: DataFrame,
                                patterns: Mapping[str, str], lateness: str | None = "2 days",
                                schema: T.StructType | None = None, prefer: str = "short",
                                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of per-day counts (long form, zero counts absent).

    With ``lateness`` the day windows close under a watermark (append mode
    emits each day once). ``lateness=None`` keeps every day open, for
    ``complete`` / ``update`` output modes.
    """
    reader = spark.readStream.schema(schema or schemas.TWEET)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    tweets = reader.json(tweets_dir)
    projected = project_tweets(tweets, prefer).where(F.col("ts").isNotNull())
    joined = projected.join(influencers.select("uid", "grp"), "uid", "inner")
    flagged = keyword_flags(joined, patterns)
    names = list(patterns)
    if lateness is not None:
        flagged = flagged.withWatermark("ts", lateness)
    wide = (flagged
            .groupBy(F.window("ts", "1 day").alias("day"), "grp", "userid", "is_rt")
            .agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(n)).alias(n) for n in names]))
    wide = wide.select(F.date_format(F.col("day.start"), DAY_KEY_FORMAT).alias("date"), "grp", "userid", "is_rt",
                       "total", *names)
    return to_long_counts(wide, ["total", *names])


def start_counts_query(counts: DataFrame, path: str, checkpoint: str, trigger_seconds: int = 60):
    """Append final day counts to a Parquet folder partitioned like the batch sink."""
    return (counts.writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("regex_type", "is_rt")
            .trigger(processingTime=f"{trigger_seconds} seconds").start())
