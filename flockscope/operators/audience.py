"""Attention-weighted audience profiles.

All statistics are sums of weights and weighted indicators grouped by cluster
or account, so hot groups only cost partial aggregates. Medians use Spark's
exact ``percentile`` whose buffer is a value -> count map; ages have a small
domain, so a huge audience still needs a tiny buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import party_from_score
from .network import attention_share

# Race codes left out of the race denominators.
RACE_EXCLUDED = ("Uncoded", "Other")
AGE_LIMIT = 75


def _wmean(value: Column, weight: Column, valid: Column, null_policy: str) -> Column:
    """Weighted mean of ``value`` over rows where ``valid``.

    ``skip``: rows with a NULL value leave numerator and denominator.
    ``propagate``: any NULL value in the group makes the result NULL (R-like).
    """
    ok = valid & value.isNotNull()
    num = F.sum(F.when(ok, value * weight))
    den = F.sum(F.when(ok, weight))
    res = F.try_divide(num, den)
    if null_policy == "propagate":
        return F.when(F.count_if(valid & value.isNull()) > 0, F.lit(None).cast("double")).otherwise(res)
    if null_policy != "skip":
        raise ValueError("null_policy must be 'skip' or 'propagate'")
    return res


def cluster_audience_stats(net: DataFrame, panel: DataFrame, labels: DataFrame,
                           null_policy: str = "skip") -> DataFrame:
    """Per-cluster audience means weighted by each panelist's attention share.

    ``net``: (source, grp, count) from A2. Labels are joined first (inner) and
    the share is taken after that join and before the panel join, as in the
    analysed pipeline. Output: grp, n, age, male, dem, rep, indep, white,
    black, white_lib, log_n.
    """
    lab = labels.select(F.col("k").alias("grp")).distinct()
    shares = attention_share(net.join(lab, "grp", "inner"))
    p = panel.select(F.col("twProfileID").alias("source"), F.col("voterbase_age").alias("age"),
                     F.col("voterbase_gender").alias("gender"), F.col("voterbase_race").alias("race"),
                     party_from_score("tsmart_partisan_score").alias("party"))
    j = shares.join(p, "source", "inner")
    w = F.col("prop")
    true = F.lit(True)
    age_ok = F.col("age").isNotNull() & (F.col("age") < AGE_LIMIT)
    race_coded = F.coalesce(~F.col("race").isin(*RACE_EXCLUDED), true)

    def ind(c: Column, cond: Column) -> Column:
        return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.when(cond, 1.0).otherwise(0.0))

    party, race, gender = F.col("party"), F.col("race"), F.col("gender")
    white_lib = F.when(race.isNull() | party.isNull(), F.lit(None).cast("double")).otherwise(
        F.when((race == "Caucasian") & (party == "Democrat"), 1.0).otherwise(0.0))
    out = j.groupBy("grp").agg(
        F.sum(w).alias("n"),
        F.try_divide(F.sum(F.when(age_ok, F.col("age") * w)), F.sum(F.when(age_ok, w))).alias("age"),
        _wmean(ind(gender, gender == "Male"), w, true, null_policy).alias("male"),
        _wmean(ind(party, party == "Democrat"), w, true, null_policy).alias("dem"),
        _wmean(ind(party, party == "Republican"), w, true, null_policy).alias("rep"),
        _wmean(ind(party, party == "Independent"), w, true, null_policy).alias("indep"),
        _wmean(ind(race, race == "Caucasian"), w, race_coded, null_policy).alias("white"),
        _wmean(ind(race, race == "African-American"), w, race_coded, null_policy).alias("black"),
        _wmean(white_lib, w, race_coded, null_policy).alias("white_lib"),
    )
    return out.withColumn("log_n", F.log("n"))


# Audience categories of the per-account table (fixed names).
RACE_LEVELS = ("Asian", "African-American", "Caucasian", "Hispanic", "Other")
PARTY_LEVELS = ("Independent", "Democrat", "Republican")
GENDER_LEVELS = ("Male", "Female")


def influencer_audience(edges: DataFrame, panel: DataFrame) -> DataFrame:
    """A10: per followed account, the demographics of its panel followers.

    Age mean / sample sd / median over non-null ages; ``source_id_count`` =
    followers found in the panel (edges are distinct pairs); proportions are
    over those followers. ``*_None`` = NULL code, ``race_Unknown`` = 'Uncoded',
    ``gender_Unknown`` = any other gender code.
    """
    p = panel.select(F.col("twProfileID").alias("source"), F.col("voterbase_age").alias("age"),
                     F.col("voterbase_gender").alias("gender"), F.col("voterbase_race").alias("race"),
                     party_from_score("tsmart_partisan_score").alias("party"))
    j = edges.select("source", "target").join(p, "source", "inner")

    def share(cond: Column) -> Column:
        return F.avg(F.when(cond, 1.0).otherwise(0.0))

    race, party, gender = F.col("race"), F.col("party"), F.col("gender")
    aggs = [
        F.avg("age").alias("age_avg"),
        F.count(F.lit(1)).alias("source_id_count"),
        F.stddev_samp("age").alias("age_std"),
        F.median("age").cast("double").alias("age_median"),
        share(race == "Asian").alias("race_Asian"),
        share(race == "African-American").alias("race_African-American"),
        share(race.isNull()).alias("race_None"),
        share(race == "Uncoded").alias("race_Unknown"),
        share(race == "Caucasian").alias("race_Caucasian"),
        share(race == "Hispanic").alias("race_Hispanic"),
        share(race == "Other").alias("race_Other"),
        share(party == "Independent").alias("party_Independent"),
        share(party == "Democrat").alias("party_Democrat"),
        share(party == "Republican").alias("party_Republican"),
        share(gender == "Male").alias("gender_Male"),
        share(gender == "Female").alias("gender_Female"),
        share(gender.isNull()).alias("gender_None"),
        share(gender.isNotNull() & ~gender.isin(*GENDER_LEVELS)).alias("gender_Unknown"),
    ]
    return j.groupBy(F.col("target").alias("influencer_id")).agg(*aggs)
