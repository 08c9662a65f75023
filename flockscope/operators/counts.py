"""Keyword and follow counts.

The keyword job is one scan, one broadcast join, one aggregation: every list
becomes a boolean column and is counted with ``count_if`` in the same
``groupBy`` (the analysed pipeline re-scanned the raw tweets once per list and
per tweet kind). Counts are combinable, so a hot account only costs a partial
aggregate per input split.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (day_key, is_excluded_cluster, keyword_match, tweet_kind,
                                 tweet_text, tweet_time)
from .joins import restrict_to

COUNT_KEYS = ("date", "grp", "userid", "is_rt")


def project_tweets(tweets: DataFrame, prefer: str = "short") -> DataFrame:
    """P1-P3 + F1/F2 on the nested tweet schema.

    Output: ``id_str, uid, userid, ts, date, is_rt, text``; quotes, replies and
    retweets of quotes/replies are dropped. Retweets take the retweeted status'
    text, originals their own; the short text wins unless ``prefer="extended"``.
    """
    kind = tweet_kind(F.col("retweeted_status.id_str"), F.col("quoted_status.id_str"),
                      F.col("in_reply_to_user_id"))
    rt_text = tweet_text(F.col("retweeted_status.text"),
                         F.col("retweeted_status.extended_tweet.full_text"), prefer)
    own_text = tweet_text(F.col("text"), F.col("extended_tweet.full_text"), prefer)
    ts = tweet_time(F.col("created_at"))
    return (tweets
            .select(F.col("id_str"), F.col("user.id").alias("uid"),
                    F.coalesce(F.expr("try_cast(user.id_str AS BIGINT)"), F.col("user.id")).alias("userid"),
                    ts.alias("ts"), kind.alias("kind"),
                    F.when(kind == "retweet", rt_text).otherwise(own_text).alias("text"))
            .where(F.col("kind").isNotNull())
            .select("id_str", "uid", "userid", "ts", day_key(F.col("ts")).alias("date"),
                    (F.col("kind") == "retweet").alias("is_rt"), "text"))


def attach_cluster(tweets: DataFrame, influencers: DataFrame) -> DataFrame:
    """Inner join on the numeric user id; a duplicated uid multiplies rows."""
    infl = influencers.select("uid", "grp")
    return tweets.join(infl, "uid", "inner")


def keyword_flags(df: DataFrame, patterns: Mapping[str, str], text_col: str = "text") -> DataFrame:
    """P4 for every list in one pass: one BOOLEAN column per list name."""
    return df.withColumns({name: keyword_match(F.col(text_col), pat) for name, pat in patterns.items()})


def daily_keyword_counts(tweets: DataFrame, influencers: DataFrame, patterns: Mapping[str, str],
                         prefer: str = "short", long: bool = True) -> DataFrame:
    """A1: counts per (date, grp, userid, is_rt) of all tweets and of each list.

    ``long=True`` returns ``date, grp, userid, is_rt, regex_type, count`` with
    zero counts absent (as in the analysed output); ``long=False`` returns one
    wide row with ``total`` and one column per list.
    """
    names = list(patterns)
    if "total" in names:
        raise ValueError("'total' is reserved for the all-tweet count")
    projected = project_tweets(tweets, prefer)
    # Filter first (cheap join), then run the regexes only on matching tweets.
    flagged = keyword_flags(attach_cluster(projected, influencers), patterns)
    wide = (flagged.groupBy(*COUNT_KEYS)
            .agg(F.count(F.lit(1)).alias("total"),
                 *[F.count_if(F.col(n)).alias(n) for n in names]))
    if not long:
        return wide
    return to_long_counts(wide, ["total", *names])


def to_long_counts(wide: DataFrame, measures: list[str], keys: tuple[str, ...] = COUNT_KEYS) -> DataFrame:
    """U3 for count tables: (keys, regex_type, count) without zero rows."""
    return (wide.unpivot(list(keys), measures, "regex_type", "count")
            .where(F.col("count") > 0)
            .withColumn("count", F.col("count").cast("long")))


def user_group_counts(edges: DataFrame, influencers: DataFrame) -> DataFrame:
    """Follows per (source, grp) over edges to listed accounts."""
    infl = influencers.select(F.col("uid").alias("target"), "grp")
    return (edges.select("source", "target").join(infl, "target", "inner")
            .groupBy("source", "grp").agg(F.count(F.lit(1)).alias("count")))


def total_follows(edges: DataFrame, panelists: DataFrame | None = None) -> DataFrame:
    """A3: follows per panelist before pruning; listed panelists with none get 0."""
    deg = edges.groupBy("source").agg(F.count(F.lit(1)).alias("fols"))
    if panelists is None:
        return deg.withColumnRenamed("source", "uid")
    ids = panelists.select(F.col(panelists.columns[0]).alias("source")).distinct()
    return (ids.join(deg, "source", "left")
            .select(F.col("source").alias("uid"), F.coalesce("fols", F.lit(0)).cast("long").alias("fols")))


def follower_counts(edges: DataFrame) -> DataFrame:
    """A3: followers per account."""
    return edges.groupBy("target").agg(F.count(F.lit(1)).alias("followers"))


def cluster_daily_counts(counts: DataFrame, accounts: DataFrame | None = None,
                         since: str | None = None) -> DataFrame:
    """A4: tweets per (regex_type, grp, date), pooling is_rt.

    ``accounts`` restricts userid by semi join; ``since`` keeps days on or
    after that date. ``date`` is returned as a DATE.
    """
    df = counts.withColumn("date", F.to_date(F.col("date")))
    if since is not None:
        df = df.where(F.col("date") >= F.to_date(F.lit(since)))
    if accounts is not None:
        df = restrict_to(df, accounts, "userid", accounts.columns[0])
    return df.groupBy("regex_type", "grp", "date").agg(F.sum("count").cast("long").alias("count"))


def cluster_totals(infl: DataFrame) -> DataFrame:
    """A5: pol, blm, total per (grp, Label, meta, narrow_label)."""
    return (infl.groupBy("grp", "Label", "meta", "narrow_label")
            .agg(F.sum("pol").cast("long").alias("pol"), F.sum("blm").cast("long").alias("blm"),
                 F.sum("total").cast("long").alias("total")))


def influencer_tweet_totals(accounts: DataFrame, counts: DataFrame, labels: DataFrame,
                            lists: tuple[str, ...] = ("pol", "blm")) -> DataFrame:
    """Per-account list and total counts + cluster labels.

    Accounts without tweets get 0; accounts whose cluster has no label row are
    dropped (inner label join).
    """
    per = (counts.groupBy("userid").pivot("regex_type", [*lists, "total"]).agg(F.sum("count")))
    filled = (accounts.join(per, accounts["id"] == per["userid"], "left").drop("userid")
              .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in [*lists, "total"]}))
    lab = labels.select(F.col("k").alias("grp"), "Label", "narrow_label", "meta")
    return filled.join(lab, "grp", "inner")


def label_table(infl: DataFrame) -> DataFrame:
    """Distinct Labels joined by ', ' per (narrow_label, meta), by the string descending.

    Labels are sorted (the analysed code keeps first-seen order, which is not
    deterministic on a cluster). The set size is bounded by the cluster count.
    """
    return (infl.groupBy("narrow_label", "meta")
            .agg(F.array_join(F.array_sort(F.collect_set("Label")), ", ").alias("labels"))
            .orderBy(F.col("labels").desc()))


def excluded_summary(df: DataFrame) -> DataFrame:
    """Clusters dropped by each half of the exclusion rule, and their labels."""
    by_label = F.coalesce(F.col("Label").rlike("Hispanic|Venezuelan|Non-US"), F.lit(False))
    by_pattern = F.col("narrow_label") == "No Clear Pattern"
    either = is_excluded_cluster("Label", "narrow_label")
    return df.agg(
        F.count_distinct(F.when(by_label, F.col("grp"))).alias("n_grp_label"),
        F.count_distinct(F.when(by_pattern, F.col("grp"))).alias("n_grp_no_pattern"),
        F.array_join(F.array_sort(F.collect_set(F.when(either, F.col("Label")))), ", ").alias("excluded_labels"),
    )
