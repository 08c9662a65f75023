"""Streaming keyword counts equal the batch operator on the same tweets."""

import tempfile

from pyspark.sql import functions as F

from flockscope.operators import counts
from flockscope.plans import lists
from flockscope.plans import proxies as P
from flockscope.streaming.keyword_stream import stream_daily_keyword_counts
from tests.conftest import SF0001


def _run(spark, stream, mode, name):
    q = (stream.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="flockscope-stream-ck-")).start())
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="flockscope-stream-src-")
    tweets = P.tweets(spark, SF0001)
    # four files written one after another in time order (file mtime order = tweet time order)
    from flockscope.functions.columns import tweet_time
    timed = tweets.withColumn("__day", F.dayofmonth(tweet_time("created_at")))
    for lo, hi in ((1, 8), (8, 16), (16, 24), (24, 32)):
        (timed.where((F.col("__day") >= lo) & (F.col("__day") < hi)).drop("__day")
         .coalesce(1).write.mode("append").json(src + "/t"))
    infl = P.influencers(spark, SF0001)
    pats = lists.patterns()
    batch = counts.daily_keyword_counts(tweets, infl, pats)
    expected = sorted(tuple(r) for r in batch.collect())

    # every day kept open: the complete result equals the batch result
    full = _run(spark, stream_daily_keyword_counts(spark, src + "/t", infl, pats, lateness=None,
                                                   max_files_per_trigger=1), "complete", "kw_complete")
    assert sorted(tuple(r) for r in full.select(*batch.columns).collect()) == expected

    # with a watermark, append mode emits only closed days, each exactly as in batch
    closed = _run(spark, stream_daily_keyword_counts(spark, src + "/t", infl, pats, lateness="1 day",
                                                     max_files_per_trigger=1), "append", "kw_append")
    emitted = [tuple(r) for r in closed.select(*batch.columns).collect()]
    assert len(emitted) == len(set(emitted))
    assert set(emitted) <= set(expected)
