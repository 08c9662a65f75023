"""Registered queries: each composes library operators over the proxy tables.

Every entry is ``(spark, sf_dir) -> DataFrame`` plus, where SQL can express
it, the DuckDB oracle text. Double columns listed in ``doubles`` are rounded
to 6 decimals on both sides before comparison.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
import numpy as np

from ..functions import columns
from ..functions.columns import party_from_score
from ..session import cut_lineage, ensure_checkpoint_dir
from ..operators import counts, events, frames, network
from ..sources import sinks
from . import lists
from . import proxies as P
from .oracle import with_proxies

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    doubles: tuple[str, ...] = ()
    ref: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, doubles: tuple[str, ...] = (), ref: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in doubles}) if doubles else df
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        rounded_sql = sql
        if sql is not None and doubles:
            rep = ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in doubles)
            rounded_sql = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"
        REGISTRY[name] = Query(name, wrapped, rounded_sql, doubles, ref)
        return wrapped
    return deco


EVENTS = P.EVENT_CUTS


# =========================================================== counts
def _kw_sql() -> str:
    pats = lists.patterns("java")
    pol, blm = pats["pol"], pats["blm"]
    return with_proxies(f"""
, cls AS (
  SELECT *, CASE WHEN retweeted_id IS NOT NULL AND quoted_id IS NULL AND reply_user IS NULL THEN 'retweet'
                 WHEN retweeted_id IS NULL AND quoted_id IS NULL AND reply_user IS NULL THEN 'original' END AS kind
  FROM p_tweets)
, j AS (
  SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS date, i.grp AS grp, c.user_id AS userid,
         kind = 'retweet' AS is_rt, coalesce(short_text, extended_text) AS text
  FROM cls c JOIN p_influencers i ON i.uid = c.user_id WHERE kind IS NOT NULL)
, w AS (
  SELECT date, grp, userid, is_rt, count(*) AS total,
         count(*) FILTER (WHERE coalesce(regexp_matches(lower(text), '{pol}'), false)) AS pol,
         count(*) FILTER (WHERE coalesce(regexp_matches(lower(text), '{blm}'), false)) AS blm
  FROM j GROUP BY date, grp, userid, is_rt)
SELECT * FROM (
  SELECT date, grp, userid, is_rt, 'total' AS regex_type, total AS count FROM w
  UNION ALL SELECT date, grp, userid, is_rt, 'pol', pol FROM w
  UNION ALL SELECT date, grp, userid, is_rt, 'blm', blm FROM w) AS u
WHERE count > 0""", "p_tweets", "p_influencers")


@register("daily_keyword_counts", _kw_sql(), ref="A1 J1 P1-P4 F1 F2 U3 S4")
def q_daily_keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: keyword matches per (day, cluster, account, is_rt) for two lists."""
    return counts.daily_keyword_counts(P.tweets(spark, sf_dir), P.influencers(spark, sf_dir),
                                       lists.patterns())


@register("project_tweets", with_proxies("""
SELECT CAST(id_str AS VARCHAR) AS id_str, user_id AS userid,
       strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS date, retweeted_id IS NOT NULL AS is_rt,
       length(coalesce(short_text, extended_text)) AS text_chars
FROM p_tweets WHERE quoted_id IS NULL AND reply_user IS NULL""", "p_tweets"), ref="P1 P2 P3 F1 F2")
def q_project_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = counts.project_tweets(P.tweets(spark, sf_dir))
    return t.select("id_str", "userid", "date", "is_rt", F.length("text").alias("text_chars"))


@register("user_group_counts", with_proxies("SELECT source, grp, count FROM p_net", "p_net"), ref="A2 J2")
def q_user_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.user_group_counts(P.follows(spark, sf_dir), P.influencers(spark, sf_dir))


@register("total_follows", with_proxies("""
SELECT c.c_custkey AS uid, CAST(coalesce(f.n, 0) AS BIGINT) AS fols
FROM customer c LEFT JOIN (SELECT source, count(*) AS n FROM p_follows GROUP BY source) f ON f.source = c.c_custkey""",
                                        "p_follows"), ref="A3 J3")
def q_total_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = P.table(spark, sf_dir, "customer").select("c_custkey")
    return counts.total_follows(P.follows(spark, sf_dir), ids)


@register("follower_counts", with_proxies("SELECT target, count(*) AS followers FROM p_follows GROUP BY target",
                                          "p_follows"), ref="A3")
def q_follower_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.follower_counts(P.follows(spark, sf_dir))


@register("cluster_daily_counts", with_proxies("""
SELECT regex_type, grp, CAST(date AS DATE) AS date, CAST(sum(count) AS BIGINT) AS count
FROM p_tweet_counts WHERE CAST(date AS DATE) >= DATE '1996-01-01'
  AND userid IN (SELECT uid FROM p_influencers)
GROUP BY 1, 2, 3""", "p_tweet_counts", "p_influencers"), ref="A4 J5")
def q_cluster_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.cluster_daily_counts(P.tweet_counts(spark, sf_dir), P.influencers(spark, sf_dir).select("uid"),
                                       since="1996-01-01")


@register("influencer_tweet_totals", with_proxies("SELECT * FROM p_infl", "p_infl"), doubles=("grp_val",),
          ref="A6 J3 J4")
def q_influencer_tweet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.infl_w_tweet_count(spark, sf_dir)


@register("cluster_totals", with_proxies("""
SELECT grp, Label, meta, narrow_label, CAST(sum(pol) AS BIGINT) AS pol, CAST(sum(blm) AS BIGINT) AS blm,
       CAST(sum(total) AS BIGINT) AS total
FROM p_infl GROUP BY 1, 2, 3, 4""", "p_infl"), ref="A5")
def q_cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.cluster_totals(P.infl_w_tweet_count(spark, sf_dir))


@register("label_table", with_proxies("""
SELECT narrow_label, meta, array_to_string(list_sort(list_distinct(list(Label))), ', ') AS labels
FROM p_infl GROUP BY 1, 2""", "p_infl"), ref="A7 O1")
def q_label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.label_table(P.infl_w_tweet_count(spark, sf_dir))


@register("excluded_summary", with_proxies("""
SELECT count(DISTINCT CASE WHEN regexp_matches(Label, 'Hispanic|Venezuelan|Non-US') THEN grp END) AS n_grp_label,
       count(DISTINCT CASE WHEN narrow_label = 'No Clear Pattern' THEN grp END) AS n_grp_no_pattern,
       array_to_string(list_sort(list_distinct(list(CASE WHEN regexp_matches(Label, 'Hispanic|Venezuelan|Non-US')
                                                         OR narrow_label = 'No Clear Pattern' THEN Label END))), ', ')
         AS excluded_labels
FROM p_infl""", "p_infl"), ref="A8 P9")
def q_excluded_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.excluded_summary(P.infl_w_tweet_count(spark, sf_dir))


# =========================================================== network
@register("prune_follows", with_proxies("""
, acc AS (SELECT target FROM p_follows GROUP BY target HAVING count(*) >= 25)
, e1 AS (SELECT * FROM p_follows WHERE target IN (SELECT target FROM acc))
, src AS (SELECT source FROM e1 GROUP BY source HAVING count(*) >= 10)
SELECT source, target FROM e1 WHERE source IN (SELECT source FROM src)""", "p_follows"),
          ref="M1")
def q_prune_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.prune_follows(P.follows(spark, sf_dir), 25, 10)


@register("top_per_cluster", with_proxies("""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY grp_val DESC, id) AS rn FROM p_accounts) WHERE rn <= 50""",
                                          "p_accounts"), doubles=("grp_val",), ref="W3 O1")
def q_top_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.top_per_cluster(P.accounts(spark, sf_dir), P.ANNOTATE_PER_CLUSTER)


@register("annotation_sheet", with_proxies("""
SELECT username, description, 'https://example.org/' || location AS expanded_url,
       username || ' ' || description AS pinned_tweet_text, location, followers_count, following_count,
       following_count * 7 AS tweet_count, verified,
       'https://twitter.com/intent/user?user_id=' || CAST(id AS VARCHAR) AS url, grp AS k
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY grp_val DESC, id) AS rn FROM p_accounts) WHERE rn <= 50""",
                                           "p_accounts"), ref="W4 F8")
def q_annotation_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.annotation_sheet(P.account_profiles(spark, sf_dir), P.ANNOTATE_PER_CLUSTER)


@register("top_influencer_edges", with_proxies("""
SELECT source, target FROM p_follows WHERE target IN (SELECT uid FROM p_influencers)""",
                                               "p_follows", "p_influencers"), ref="M6 J5")
def q_top_influencer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.top_influencer_edges(P.follows(spark, sf_dir), P.influencers(spark, sf_dir))


@register("attention_share", with_proxies("SELECT source, grp, count, prop FROM p_shares", "p_shares"),
          doubles=("prop",), ref="W1")
def q_attention_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = counts.user_group_counts(P.follows(spark, sf_dir), P.influencers(spark, sf_dir))
    lab = P.labels(spark, sf_dir).select(F.col("k").alias("grp"))
    return network.attention_share(net.join(lab, "grp", "inner")).select("source", "grp", "count", "prop")


# =========================================================== audience
_STATS = ("n", "age", "male", "dem", "rep", "indep", "white", "black", "white_lib", "log_n")


@register("cluster_audience_stats", with_proxies("SELECT * FROM p_clust_stats", "p_clust_stats"),
          doubles=_STATS, ref="A9 W1 P12 J4")
def q_cluster_audience_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clust_stats(spark, sf_dir)


_AUD = ("age_avg", "age_std", "age_median", "race_Asian", "race_African-American", "race_None", "race_Unknown",
        "race_Caucasian", "race_Hispanic", "race_Other", "party_Independent", "party_Democrat", "party_Republican",
        "gender_Male", "gender_Female", "gender_None", "gender_Unknown")


@register("influencer_audience", with_proxies("SELECT * FROM p_infl_audience", "p_infl_audience"),
          doubles=_AUD, ref="A10")
def q_influencer_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.infl_audience(spark, sf_dir)


# =========================================================== events
def _event_sql(daily_from: str) -> str:
    cases = []
    for cut, name in EVENTS:
        d = f"date_diff('day', DATE '{cut}', CAST(date AS DATE))"
        cases.append(f"""
  SELECT grp, regex_type, count, '{name}' AS event,
         CASE WHEN {d} <= -22 OR {d} >= 49 THEN NULL WHEN {d} < -14 THEN -2 WHEN {d} < -7 THEN -1
              WHEN {d} >= 42 THEN 6 WHEN {d} >= 35 THEN 5 WHEN {d} >= 28 THEN 4 WHEN {d} >= 21 THEN 3
              WHEN {d} >= 14 THEN 2 WHEN {d} >= 7 THEN 1 ELSE 0 END AS t_idx
  FROM {daily_from}""")
    return f"""
binned AS (SELECT * FROM ({' UNION ALL '.join(cases)}) AS b WHERE t_idx IS NOT NULL),
wide AS (SELECT grp, event, t_idx, sum(count) FILTER (WHERE regex_type = 'total') AS total,
                sum(count) FILTER (WHERE regex_type = 'pol') AS pol,
                sum(count) FILTER (WHERE regex_type = 'blm') AS blm
         FROM binned GROUP BY 1, 2, 3),
ew AS (
  SELECT grp, CASE WHEN t_idx > 0 THEN '+' || CAST(t_idx AS VARCHAR) ELSE CAST(t_idx AS VARCHAR) END AS t,
         CAST(t_idx AS INTEGER) AS t_idx, regex_type, CAST(polcnt AS BIGINT) AS polcnt, CAST(total AS BIGINT) AS total, event
  FROM (SELECT grp, event, t_idx, total, 'pol' AS regex_type, pol AS polcnt FROM wide
        UNION ALL SELECT grp, event, t_idx, total, 'blm', blm FROM wide) AS l
  WHERE total IS NOT NULL AND polcnt IS NOT NULL)"""


_DAILY_ALL = """daily AS (SELECT regex_type, grp, CAST(date AS DATE) AS date, sum(count) AS count
                          FROM p_tweet_counts GROUP BY 1, 2, 3)"""


@register("event_window", with_proxies(f""",
{_DAILY_ALL},
{_event_sql('daily')}
SELECT * FROM ew""", "p_tweet_counts"), ref="X1 A4 J7 P8 P13 F4")
def q_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = counts.cluster_daily_counts(P.tweet_counts(spark, sf_dir))
    return events.event_window(daily, EVENTS)


_PANEL_SQL_BODY = f""",
daily AS (SELECT regex_type, grp, CAST(date AS DATE) AS date, sum(count) AS count
          FROM p_tweet_counts WHERE userid IN (SELECT id FROM p_infl) GROUP BY 1, 2, 3),
{_event_sql('daily')},
lab AS (SELECT grp, Label, narrow_label, meta FROM (
          SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS rn FROM p_infl) WHERE rn = 1),
panel AS (
  SELECT ew.*, lab.Label, lab.narrow_label, lab.meta, s.* EXCLUDE (grp), s.rep - s.dem AS par_diff
  FROM ew JOIN lab ON lab.grp = ew.grp JOIN p_clust_stats s ON s.grp = ew.grp
  WHERE NOT (coalesce(regexp_matches(lab.Label, 'Hispanic|Venezuelan|Non-US'), false)
             OR lab.narrow_label = 'No Clear Pattern'))"""


@register("cluster_event_panel", with_proxies(_PANEL_SQL_BODY + "\nSELECT * FROM panel", "p_tweet_counts", "p_infl",
                                              "p_clust_stats"),
          doubles=(*_STATS, "par_diff"), ref="X10 W2 P9 J4 U1")
def q_cluster_event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir)


@register("pooled_proportions", with_proxies(_PANEL_SQL_BODY + """
SELECT t, event, regex_type, x, n, x / n AS mean,
       (x + 1.959963984540054 ^ 2 / 2) / (n + 1.959963984540054 ^ 2)
         - 1.959963984540054 * sqrt(((x + 1.959963984540054 ^ 2 / 2) / (n + 1.959963984540054 ^ 2))
             * (1 - (x + 1.959963984540054 ^ 2 / 2) / (n + 1.959963984540054 ^ 2)) / (n + 1.959963984540054 ^ 2)) AS lower,
       (x + 1.959963984540054 ^ 2 / 2) / (n + 1.959963984540054 ^ 2)
         + 1.959963984540054 * sqrt(((x + 1.959963984540054 ^ 2 / 2) / (n + 1.959963984540054 ^ 2))
             * (1 - (x + 1.959963984540054 ^ 2 / 2) / (n + 1.959963984540054 ^ 2)) / (n + 1.959963984540054 ^ 2)) AS upper
FROM (SELECT t, event, regex_type, CAST(sum(polcnt) AS BIGINT) AS x, CAST(sum(total) AS BIGINT) AS n
      FROM panel GROUP BY 1, 2, 3) AS a""", "p_tweet_counts", "p_infl", "p_clust_stats"),
          doubles=("mean", "lower", "upper"), ref="A11 X4")
def q_pooled_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.pooled_proportions(_panel(spark, sf_dir))


def _reused(df: DataFrame) -> DataFrame:
    """Cache an intermediate that a query reads more than once."""
    return df.persist()


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.cluster_event_panel(P.tweet_counts(spark, sf_dir), _reused(P.infl_w_tweet_count(spark, sf_dir)),
                                      P.clust_stats(spark, sf_dir), EVENTS)


# =========================================================== frames
_X11_SQL = """,
tot AS (SELECT grp, Label, meta, narrow_label, sum(pol) AS pol, sum(blm) AS blm, sum(total) AS total
        FROM p_infl GROUP BY 1, 2, 3, 4),
x11 AS (
  SELECT l.grp, l.Label, l.meta, l.narrow_label, CAST(l.total AS BIGINT) AS total, l.issuepublic,
         CAST(l.polcnt AS BIGINT) AS polcnt, s.* EXCLUDE (grp), s.rep - s.dem AS par_diff,
         CAST(l.polcnt AS DOUBLE) / l.total AS v
  FROM (SELECT grp, Label, meta, narrow_label, total, 'pol' AS issuepublic, pol AS polcnt FROM tot
        UNION ALL SELECT grp, Label, meta, narrow_label, total, 'blm', blm FROM tot) AS l
  JOIN p_clust_stats s ON s.grp = l.grp
  WHERE NOT (coalesce(regexp_matches(l.Label, 'Hispanic|Venezuelan|Non-US'), false)
             OR l.narrow_label = 'No Clear Pattern'))"""


def _x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.cluster_overlap_long(P.infl_w_tweet_count(spark, sf_dir), P.clust_stats(spark, sf_dir))


@register("cluster_overlap_long", with_proxies(_X11_SQL + "\nSELECT * FROM x11", "p_infl", "p_clust_stats")
          , doubles=(*_STATS, "par_diff", "v"), ref="X11 A5 P9 U3 P16")
def q_cluster_overlap_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x11(spark, sf_dir)


@register("correlation_matrix", with_proxies(_X11_SQL + """
SELECT * FROM (
  SELECT 'age' AS var1, 'male' AS var2, corr(age, male) AS r FROM x11
  UNION ALL SELECT 'age', 'par_diff', corr(age, par_diff) FROM x11
  UNION ALL SELECT 'age', 'log_n', corr(age, log_n) FROM x11
  UNION ALL SELECT 'male', 'par_diff', corr(male, par_diff) FROM x11
  UNION ALL SELECT 'male', 'log_n', corr(male, log_n) FROM x11
  UNION ALL SELECT 'par_diff', 'log_n', corr(par_diff, log_n) FROM x11) AS c""", "p_infl", "p_clust_stats")
          , doubles=("r",), ref="A16")
def q_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.correlation_matrix(_x11(spark, sf_dir), ["age", "male", "par_diff", "log_n"])


@register("linear_trend", with_proxies(_X11_SQL + """,
w AS (SELECT grp, max(v) FILTER (WHERE issuepublic = 'pol') AS pol_rate,
             max(v) FILTER (WHERE issuepublic = 'blm') AS blm_rate FROM x11 GROUP BY grp)
SELECT regr_slope(blm_rate, pol_rate) AS slope, regr_intercept(blm_rate, pol_rate) AS intercept,
       regr_r2(blm_rate, pol_rate) AS r2, regr_count(blm_rate, pol_rate) AS n, corr(blm_rate, pol_rate) AS r,
       corr(blm_rate, pol_rate) * sqrt((regr_count(blm_rate, pol_rate) - 2)
         / (1 - corr(blm_rate, pol_rate) * corr(blm_rate, pol_rate))) AS t_stat
FROM w""", "p_infl", "p_clust_stats"),
          doubles=("slope", "intercept", "r2", "r", "t_stat"), ref="A17")
def q_linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _overlap_rates(spark, sf_dir)
    return frames.linear_trend(w, "blm_rate", "pol_rate").withColumn("n", F.col("n").cast("long")).drop("p_value")


def _overlap_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda name: F.max(F.when(F.col("issuepublic") == name, F.col("v"))).alias(f"{name}_rate")
    return _x11(spark, sf_dir).groupBy("grp", "meta").agg(rate("pol"), rate("blm"))


@register("trend_significance", None, ref="A17")
def q_trend_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap trend over all clusters (meta NULL) and within each type, with p-values."""
    w = _overlap_rates(spark, sf_dir)
    whole = frames.linear_trend(w, "blm_rate", "pol_rate").withColumn("meta", F.lit(None).cast("string"))
    cols = ["meta", "slope", "r", "n", "t_stat", "p_value"]
    return whole.select(*cols).unionByName(frames.linear_trend(w, "blm_rate", "pol_rate", ["meta"]).select(*cols))


@register("quantiles", with_proxies(_X11_SQL + """
SELECT issuepublic, quantile_cont(v, 0.025) AS q2_5, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.975) AS q97_5
FROM x11 GROUP BY issuepublic""", "p_infl", "p_clust_stats"),
          doubles=("q2_5", "q50", "q97_5"), ref="A14 A15")
def q_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.quantiles(_x11(spark, sf_dir), "v", [0.025, 0.5, 0.975], ["issuepublic"])


@register("log_odds", with_proxies(""",
tot AS (SELECT grp, sum(pol) AS pol, sum(blm) AS blm FROM p_infl GROUP BY grp),
s AS (SELECT sum(pol) AS s1, sum(blm) AS s2, count(*) AS v FROM tot)
SELECT grp, CAST(pol AS BIGINT) AS pol, CAST(blm AS BIGINT) AS blm,
       ln((pol + 1.0) / (s1 + v - (pol + 1.0))) - ln((blm + 1.0) / (s2 + v - (blm + 1.0))) AS delta,
       1.0 / (pol + 1.0) + 1.0 / (blm + 1.0) AS sigma,
       (ln((pol + 1.0) / (s1 + v - (pol + 1.0))) - ln((blm + 1.0) / (s2 + v - (blm + 1.0))))
         / sqrt(1.0 / (pol + 1.0) + 1.0 / (blm + 1.0)) AS val
FROM tot, s""", "p_infl"), doubles=("delta", "sigma", "val"), ref="W6")
def q_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tot = (P.infl_w_tweet_count(spark, sf_dir).groupBy("grp")
           .agg(F.sum("pol").cast("long").alias("pol"), F.sum("blm").cast("long").alias("blm")))
    return frames.log_odds(tot, "pol", "blm")


_X12_DOUBLES = ("age_avg", "gender_Male", "gender_Female", "party_Independent", "party_Democrat",
                "party_Republican", "approx_rw_centr", "par_diff", "male", "pop", "cent_pardiff", "cent_age",
                "cent_male", "cent_fol", "cent_pop", "cent_bet")


@register("account_model_frame", with_proxies(""",
rq AS (
  SELECT i.id, i.meta, i.grp, i.verified, i.description, i.username, i.followers_count, i.following_count,
         i.Label, i.total, a.age_avg, a."gender_Male", a."gender_Female", a."party_Independent",
         a."party_Democrat", a."party_Republican", c.approx_rw_centr, a.source_id_count, i.pol, i.blm
  FROM p_infl i JOIN p_infl_audience a ON a.influencer_id = i.id JOIN p_centrality c ON c.id = i.id
  WHERE i.total >= 5 AND i.followers_count >= 1000
    AND NOT (coalesce(regexp_matches(i.Label, 'Hispanic|Venezuelan|Non-US'), false)
             OR i.narrow_label = 'No Clear Pattern')),
lg AS (
  SELECT * EXCLUDE (pol, blm), 'pol' AS variable, pol AS value FROM rq
  UNION ALL SELECT * EXCLUDE (pol, blm), 'blm', blm FROM rq),
d AS (
  SELECT *, "party_Republican" - "party_Democrat" AS par_diff, "gender_Male" - "gender_Female" AS male,
         ln((followers_count + 1.0) / (following_count + 1.0)) AS pop, ln(CAST(followers_count AS DOUBLE)) AS log_fol
  FROM lg WHERE age_avg IS NOT NULL AND "party_Republican" - "party_Democrat" IS NOT NULL
    AND "gender_Male" - "gender_Female" IS NOT NULL)
SELECT * EXCLUDE (log_fol),
  (par_diff - avg(par_diff) OVER g) / NULLIF(2 * stddev_samp(par_diff) OVER g, 0) AS cent_pardiff,
  (age_avg - avg(age_avg) OVER g) / NULLIF(2 * stddev_samp(age_avg) OVER g, 0) AS cent_age,
  (male - avg(male) OVER g) / NULLIF(2 * stddev_samp(male) OVER g, 0) AS cent_male,
  (log_fol - avg(log_fol) OVER g) / NULLIF(2 * stddev_samp(log_fol) OVER g, 0) AS cent_fol,
  (pop - avg(pop) OVER g) / NULLIF(2 * stddev_samp(pop) OVER g, 0) AS cent_pop,
  (approx_rw_centr - avg(approx_rw_centr) OVER g) / NULLIF(2 * stddev_samp(approx_rw_centr) OVER g, 0) AS cent_bet
FROM d WINDOW g AS (PARTITION BY grp)""", "p_infl", "p_infl_audience", "p_centrality"),
          doubles=_X12_DOUBLES, ref="X12 P10 P9 P11 P16 U3 W5 J4")
def q_account_model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.account_model_frame(P.infl_w_tweet_count(spark, sf_dir), P.infl_audience(spark, sf_dir),
                                      P.centrality(spark, sf_dir))


# =========================================================== assignments
@register("assign_clusters", """
SELECT vec_id AS id, k, CAST(list_position(l, list_max(l)) AS INTEGER) AS grp, list_max(l) AS grp_val
FROM (SELECT vec_id, k, list_transform(range(k), lambda i: list_sum(list_slice(CAST(embedding AS DOUBLE[]), i * (64 // k) + 1, (i + 1) * (64 // k)))) AS l
      FROM embeddings, (VALUES (16), (32), (64)) AS ks(k)) AS s""", doubles=("grp_val",), ref="M4 F11 K3")
def q_assign_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.assign_clusters(P.loadings(spark, sf_dir))


@register("panel_frame", with_proxies("""
SELECT p.*, z.grp, l.Label, l.narrow_label, l.meta, l.Metalabel1,
       c.c_name AS name, lower(c.c_name) AS screen_name, c.c_mktsegment AS description,
       CAST(trunc(c.c_acctbal) AS BIGINT) AS followers_count
FROM p_panel p
JOIN (SELECT c_custkey AS id, c_nationkey AS grp FROM customer) z ON z.id = p.twProfileID
LEFT JOIN p_labels l ON l.k = z.grp
JOIN customer c ON c.c_custkey = p.twProfileID""", "p_panel", "p_labels"), doubles=("tsmart_partisan_score",),
          ref="X13 J3 J4")
def q_panel_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = P.panel(spark, sf_dir).withColumn("party", party_from_score("tsmart_partisan_score"))
    return network.panel_frame(panel, P.panel_assignments(spark, sf_dir), P.labels(spark, sf_dir),
                               P.panel_profiles(spark, sf_dir))


@register("influencer_frame", with_proxies("""
, nb AS (
  SELECT p_partkey AS id, upper(p_name) AS username, 'acct/' || CAST(p_partkey AS VARCHAR) AS expanded_url,
         CAST(TIMESTAMP '2020-01-01 00:00:00' + to_days(p_size) AS TIMESTAMP) AS created_at, p_type AS description
  FROM part WHERE p_brand = 'Brand#13'),
nb2 AS (SELECT nb.*, a.grp, a.grp_val FROM nb JOIN p_accounts a ON a.id = nb.id),
m AS (
  SELECT id, grp, grp_val, username, description, location, followers_count, following_count, verified,
         NULL::VARCHAR AS expanded_url, NULL::TIMESTAMP AS created_at
  FROM p_accounts WHERE id NOT IN (SELECT id FROM nb2)
  UNION ALL
  SELECT id, grp, grp_val, username, description, NULL, NULL, NULL, NULL, expanded_url, created_at FROM nb2)
SELECT m.*, l.Label, l.narrow_label, l.meta, l.Metalabel1, lower(m.username) AS sn_lower
FROM m JOIN p_labels l ON l.k = m.grp""", "p_accounts", "p_labels"),
          doubles=("grp_val",), ref="X14 U2 J6 F5 F6")
def q_influencer_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.merge_new_bios(P.accounts(spark, sf_dir), P.new_bios(spark, sf_dir), P.labels(spark, sf_dir))


def queries() -> dict[str, QueryFn]:
    return {n: q.fn for n, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q.sql for n, q in REGISTRY.items() if q.sql is not None}


# =========================================================== agreement
from ..operators import agreement  # noqa: E402

_ASSIGN_SQL = """
assign AS (
  SELECT vec_id AS id, k, CAST(list_position(l, list_max(l)) AS INTEGER) AS grp
  FROM (SELECT vec_id, k, list_transform(range(k), lambda i: list_sum(list_slice(CAST(embedding AS DOUBLE[]), i * (64 // k) + 1, (i + 1) * (64 // k)))) AS l
        FROM embeddings, (VALUES (16), (32), (64)) AS ks(k)) AS s
  UNION ALL SELECT vec_id, 0, label FROM embeddings),
pairs AS (
  SELECT a.id, a.k AS k1, b.k AS k2, a.grp AS g1, b.grp AS g2 FROM assign a JOIN assign b ON a.id = b.id AND a.k <> b.k),
cont AS (SELECT k1, k2, g1, g2, count(*) AS nij FROM pairs GROUP BY ALL),
ma AS (SELECT k1, k2, g1, sum(nij) AS a FROM cont GROUP BY ALL),
mb AS (SELECT k1, k2, g2, sum(nij) AS b FROM cont GROUP BY ALL),
nn AS (SELECT k1, k2, CAST(sum(nij) AS DOUBLE) AS N FROM cont GROUP BY ALL),
mi AS (SELECT c.k1, c.k2, sum(nij / N * ln(N * nij / (a * b))) AS mi, sum(nij * (nij - 1) / 2.0) AS s_ij, any_value(N) AS N
       FROM cont c JOIN ma USING (k1, k2, g1) JOIN mb USING (k1, k2, g2) JOIN nn USING (k1, k2) GROUP BY ALL),
hu AS (SELECT k1, k2, -sum(a / N * ln(a / N)) AS hu, sum(a * (a - 1) / 2.0) AS s_a FROM ma JOIN nn USING (k1, k2) GROUP BY ALL),
hv AS (SELECT k1, k2, -sum(b / N * ln(b / N)) AS hv, sum(b * (b - 1) / 2.0) AS s_b FROM mb JOIN nn USING (k1, k2) GROUP BY ALL),
cells AS (SELECT k1, k2, a, b, N, unnest(generate_series(greatest(1, CAST(a + b - N AS BIGINT)), CAST(least(a, b) AS BIGINT))) AS x
          FROM ma JOIN mb USING (k1, k2) JOIN nn USING (k1, k2)),
emi AS (SELECT k1, k2, sum(x / N * ln(N * x / (a * b)) * exp(
          lgamma(a + 1) + lgamma(b + 1) + lgamma(N - a + 1) + lgamma(N - b + 1) - lgamma(N + 1)
          - lgamma(x + 1) - lgamma(a - x + 1) - lgamma(b - x + 1) - lgamma(N - a - b + x + 1))) AS emi
        FROM cells GROUP BY ALL),
agree AS (
  SELECT k1, k2, mi, hu, hv, mi / greatest(hu, hv) AS nmi,
         (s_ij - s_a * s_b / (N * (N - 1) / 2)) / ((s_a + s_b) / 2 - s_a * s_b / (N * (N - 1) / 2)) AS ari,
         emi, (mi - emi) / (greatest(hu, hv) - emi) AS ami
  FROM mi JOIN hu USING (k1, k2) JOIN hv USING (k1, k2) JOIN emi USING (k1, k2))"""


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_k = network.assign_clusters(P.loadings(spark, sf_dir)).select("id", "k", "grp")
    return by_k.unionByName(P.label_assignments(spark, sf_dir))


@register("cluster_agreement", "WITH " + _ASSIGN_SQL + "\nSELECT * FROM agree",
          doubles=("mi", "hu", "hv", "nmi", "ari", "emi", "ami"), ref="A12 J8 X5")
def q_cluster_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.cluster_agreement(_assignments(spark, sf_dir))


@register("assignment_pairs", "WITH " + _ASSIGN_SQL + "\nSELECT id, k1, k2, g1, g2 FROM pairs",
          ref="J8 U1")
def q_assignment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.assignment_pairs(_assignments(spark, sf_dir))


@register("mean_agreement", "WITH " + _ASSIGN_SQL + """
SELECT k1, avg(ami) AS mean, count(*) AS n_pairs FROM agree GROUP BY k1""", doubles=("mean",), ref="M7 A13")
def q_mean_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.mean_agreement(agreement.cluster_agreement(_assignments(spark, sf_dir)))


@register("choose_k", "WITH " + _ASSIGN_SQL + """
SELECT arg_max(k1, struct_pack(m := mean, negk := -k1)) AS k, max(mean) AS mean
FROM (SELECT k1, avg(ami) AS mean FROM agree GROUP BY k1) AS s""", doubles=("mean",), ref="M7 K3")
def q_choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.choose_k(agreement.cluster_agreement(_assignments(spark, sf_dir)))


@register("agreement_bootstrap_ci", None, ref="A13")
def q_agreement_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    agree = agreement.cluster_agreement(_assignments(spark, sf_dir))
    return agreement.bootstrap_mean_ci(agree, "k1", "ami", conf=0.66, reps=1000, seed=779)


# =========================================================== models (G1-G14), rows-only checks
from ..stats import glm as _glm  # noqa: E402
from ..stats import mixed as _mixed  # noqa: E402
from ..stats import models as _models  # noqa: E402
from ..stats.design import make_design, star  # noqa: E402

T_LEVELS = ("-2", "-1", "0", "+1", "+2", "+3", "+4", "+5", "+6")


def _few(df: DataFrame) -> DataFrame:
    """Written rows in as many partitions as there are cores, at most: a fit passes over them many times."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def _x11_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``_x11`` for models, two per cluster: written, as designs and fits read them many times."""
    return _few(cut_lineage(_x11(spark, sf_dir)))


def _x11_design(x11: DataFrame, full: bool = True):
    terms = star("issuepublic", "meta")
    if full:
        terms += [("age",), ("age", "issuepublic"), ("par_diff",), ("par_diff", "issuepublic"),
                  ("male",), ("male", "issuepublic"), ("log_n",), ("log_n", "issuepublic")]
    return make_design(x11, terms, factors=["issuepublic", "meta"], levels={"issuepublic": ["blm", "pol"]},
                       poly=["par_diff"])


@register("binomial_fit", None, ref="G5 G1 G2 G8 G9")
def q_binomial_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster-level overlap model (base + audience terms) with grp-clustered SEs."""
    x11 = _x11_rows(spark, sf_dir)
    fit = _glm.binomial_fit(x11, _x11_design(x11), "v", "total")
    return _glm.coef_table(spark, fit, _glm.cluster_vcov(fit, x11, "grp"))


@register("avg_predictions", None, ref="G11 J9 G8")
def q_avg_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterfactual average overlap over a 25-point age grid, by issue public."""
    x11 = _x11_rows(spark, sf_dir)
    fit = _glm.binomial_fit(x11, _x11_design(x11), "v", "total")
    rng = x11.agg(F.min("age").alias("lo"), F.max("age").alias("hi")).first()
    grid = list(np.linspace(float(rng["lo"]), float(rng["hi"]), 25))
    return _glm.avg_predictions(fit, x11, "age", grid, ["issuepublic"], _glm.cluster_vcov(fit, x11, "grp"))


@register("model_compare", None, ref="G10 G5")
def q_model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    x11 = _x11_rows(spark, sf_dir)
    base = _glm.binomial_fit(x11, _x11_design(x11, False), "v", "total")
    full = _glm.binomial_fit(x11, _x11_design(x11, True), "v", "total")
    return _models.compare_models(spark, {"base": base, "full": full}, {"full": "base"})


def _lmm_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with proportions: some rows per cluster and week, written, as levels and fits read them many times."""
    return _few(cut_lineage(_panel(spark, sf_dir).withColumn("v", F.col("polcnt") / F.col("total"))))


def _lmm_design(df: DataFrame, with_meta: bool):
    terms = star("t", "regex_type", "event", *(("meta",) if with_meta else ()))
    return make_design(df, terms, factors=["t", "regex_type", "event", "meta"], levels={"t": list(T_LEVELS)})


@register("mixed_fit", None, ref="G3 G1")
def q_mixed_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-intercept model v ~ t*regex_type*event + (1|grp), REML."""
    df = _lmm_frame(spark, sf_dir)
    fit = _mixed.mixed_fit(df, _lmm_design(df, False), "v", "grp", reml=True)
    rows = [(n, float(b), float(np.sqrt(fit.cov[i, i]))) for i, (n, b) in enumerate(zip(fit.kept_names, fit.beta))]
    rows += [("sigma2", float(fit.sigma2), None), ("sigma_b2", float(fit.sigma_b2), None),
             ("loglik_reml", float(fit.loglik), None)]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double")


@register("mixed_predict", None, ref="G4 J9 U6")
def q_mixed_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population-level predictions of t*event*regex_type*meta on the full level grid."""
    df = _lmm_frame(spark, sf_dir)
    fit = _mixed.mixed_fit(df, _lmm_design(df, True), "v", "grp", reml=True)
    grid = _mixed.prediction_grid(df, ["t", "regex_type", "event", "meta"])
    return _mixed.mixed_predict(spark, fit, grid)


@register("mixed_compare", None, ref="G10 G3")
def q_mixed_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML refits of the nested random-intercept models with LR tests."""
    df = _lmm_frame(spark, sf_dir)
    fits = {}
    for name, terms in (("b1", [("regex_type",)]), ("b2", [("t",), ("regex_type",), ("event",)]),
                        ("b5", star("t", "regex_type", "event"))):
        d = make_design(df, terms, factors=["t", "regex_type", "event"], levels={"t": list(T_LEVELS)})
        fits[name] = _mixed.mixed_fit(df, d, "v", "grp", reml=False)
    return _models.compare_models(spark, fits, {"b2": "b1", "b5": "b2"})


@register("mixed_cell_means", "WITH p AS (\n" + REGISTRY["cluster_event_panel"].sql + "\n)\n" + """
SELECT t, regex_type, event, sum(polcnt / total) / count(*) AS fitted, CAST(count(*) AS BIGINT) AS n
FROM p WHERE polcnt IS NOT NULL AND total > 0 GROUP BY ALL""", doubles=("fitted",), ref="G4 G3 U6")
def q_mixed_cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean fitted value, group intercepts included, of every cell of the saturated random-intercept model:
    the observed mean, by the model's normal equations."""
    df = _lmm_frame(spark, sf_dir).where("v IS NOT NULL")
    fit = _mixed.mixed_fit(df, _lmm_design(df, False), "v", "grp", reml=True)
    return (_mixed.mixed_predict(spark, fit, df, population=False).groupBy("t", "regex_type", "event")
            .agg(F.avg("estimate").alias("fitted"), F.count(F.lit(1)).alias("n")))


def _x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account rows of the models, without the texts of profiles; written, as levels and fits read them many times."""
    rows = (frames.account_model_frame(P.infl_w_tweet_count(spark, sf_dir), P.infl_audience(spark, sf_dir),
                                       P.centrality(spark, sf_dir))
            .withColumn("v", F.col("value") / F.col("total"))
            .withColumn("verified", F.col("verified").cast("string")))
    return _few(cut_lineage(rows.drop("description", "username", "Label", "followers_count", "following_count", "source_id_count")))


def _fe_design(df: DataFrame, extra: list = ()):
    terms = [*star("verified", "variable", "meta"), ("cent_pop",), ("cent_pop", "variable"), ("cent_pop", "meta"),
             ("cent_pop", "variable", "meta"), *extra]
    terms = [t for t in terms if t not in (("variable",), ("meta",), ("variable", "meta"))]
    return make_design(df, terms, factors=["verified", "variable", "meta"], poly=["cent_pardiff"])


@register("fe_binomial_fit", None, ref="G6 G1 G2")
def q_fe_binomial_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-level FE logit: (verified + cent_pop)*variable*meta + age / partisanship terms | variable + grp."""
    df = _x12(spark, sf_dir)
    extra = [("cent_age",), ("cent_age", "variable"), ("cent_age", "meta"), ("cent_age", "variable", "meta"),
             ("cent_pardiff",), ("cent_pardiff", "variable"), ("cent_pardiff", "meta")]
    fit = _models.fe_binomial_fit(df, _fe_design(df, extra), "v", "total", ["variable", "grp"])
    return _glm.coef_table(spark, fit)


@register("subset_models", None, ref="G7 G6 G10")
def q_subset_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subsets of {verified, cent_fol, cent_pop} with variable + grp fixed effects."""
    df = _x12(spark, sf_dir)
    base = make_design(df, [("verified",)], factors=["verified"])
    base.terms = []
    fits = _models.subset_models(df, base, [("verified",), ("cent_fol",), ("cent_pop",)], "v", "total",
                                 ["variable", "grp"])
    named = {"+".join(t[0] for t in k) or "base": f for k, f in fits.items()}
    return _models.compare_models(spark, named, {n: "base" for n in named if n != "base"})


@register("fit_diagnostics", None, ref="G14")
def q_fit_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed vs fitted of base and full FE models, one row per account x public."""
    df = _x12(spark, sf_dir)
    base = _models.fe_binomial_fit(df, make_design(df, []), "v", "total", ["variable", "grp"])
    full = _models.fe_binomial_fit(df, _full_design(df), "v", "total", ["variable", "grp"])
    diag = _models.fit_diagnostics(df, {"base": base, "full": full}, "v", "total")
    return diag.select("id", "variable", "observed", "pred_base", "pred_full")


from ..stats import bootstrap as _boot  # noqa: E402

# Replicates of the registered bootstrap query (as in the analysed pipeline).
BOOT_REPS = 1000


#: Account predictors of the full model, in the order the blocks enter.
FULL_PREDICTORS = ["cent_pop", "cent_age", "cent_pardiff", "cent_male", "cent_bet"]


def _crossed(name: str) -> list[tuple]:
    """A predictor with its interactions with issue public and cluster kind."""
    return [(name,), (name, "variable"), (name, "meta"), (name, "variable", "meta")]


def _full_design(df: DataFrame):
    """Every predictor by issue public by cluster kind; partisanship enters as a quadratic."""
    return _fe_design(df, [t for name in FULL_PREDICTORS[1:] for t in _crossed(name)])


@register("bootstrap_curves", None, ref="G13 G12 U5 A14 G11")
def q_bootstrap_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population-averaged curves of the full FE account model with cluster-bootstrap CIs: five predictors and ``verified``."""
    df = _x12(spark, sf_dir)
    fit = _models.fe_binomial_fit(df, _full_design(df), "v", "total", ["variable", "grp"])
    return _boot.bootstrap_curves(spark, fit, df, FULL_PREDICTORS, ["meta", "variable"], "grp",
                                  discrete=["verified"], reps=BOOT_REPS, grid_n=20, seed=779, batch=BOOT_REPS)


@register("fe_model_sequence", None, ref="G6 G10")
def q_fe_model_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account models from fixed effects alone to the full one and its robustness check, each against its predecessors."""
    df = _x12(spark, sf_dir)
    first = [("verified",), ("cent_pop",)]
    by = lambda *over: [(*t, *over) for t in first]
    m2 = {"m2a": first, "m2b": first + by("meta"), "m2c": first + by("variable")}
    m2["m2d"] = m2["m2b"] + by("variable") + by("variable", "meta")
    age = _crossed("cent_age")
    steps = m2 | {"base": [], "age1": m2["m2d"] + age[:1], "age2": m2["m2d"] + age[:2], "age3": m2["m2d"] + [age[0], age[2]],
                  "age4": m2["m2d"] + age[:3], "age5": m2["m2d"] + age}
    steps["pardiff"] = steps["age5"] + _crossed("cent_pardiff")
    steps["male"] = steps["pardiff"] + _crossed("cent_male")
    steps["full"] = steps["male"] + _crossed("cent_bet")
    raw = ["par_diff", "age_avg", "male", "pop", "approx_rw_centr"]
    steps["robustness"] = steps["full"] + [t for name in raw for t in _crossed(name)]
    design = lambda rows, terms: make_design(rows, terms, factors=["verified", "variable", "meta"],
                                             poly=["cent_pardiff", "par_diff"])
    df = cut_lineage(_models.common_rows(df, design(df, steps["robustness"])))  # compared models use the same rows
    fits = {name: _models.fe_binomial_fit(df, design(df, terms), "v", "total", ["variable", "grp"]) for name, terms in steps.items()}
    smaller = {"m2a": "base", "m2b": "m2a", "m2c": "m2a", "m2d": "m2b", "age1": "m2d", "age2": "age1", "age3": "age1",
               "age4": "age2", "age5": "age4", "pardiff": "age5", "male": "pardiff", "full": "male", "robustness": "full"}
    return _models.compare_models(spark, fits, smaller)


from ..operators import factor as _factor  # noqa: E402


def _stored_factors(spark: SparkSession, sf_dir: str, ks: list[int]) -> str:
    """Folder of the factors of the pruned follow graph, written by K4 below the shared checkpoint folder."""
    edges = network.prune_follows(P.planted_follows(spark, sf_dir), 25, 10)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/factors-{uuid.uuid4().hex}"
    sinks.save_factors(_factor.sweep_factors(edges, ks, seed=42), path)
    return path


#: Eight settings up to the number of planted blocks.
SWEEP = [5, 8, 11, 14, 17, 20, 23, 25]


@register("vsp_sweep", None, ref="M1 M2 M3 M4 M5 K4")
def q_vsp_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned follow graph -> one converged factorisation -> varimax for eight k -> factors saved and reloaded -> assignments."""
    return _factor.assign_from_loadings(sinks.load_factors(spark, _stored_factors(spark, sf_dir, SWEEP)))


@register("vsp_mixing", None, ref="M3 K4")
def q_vsp_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing matrix between the panelists' and the accounts' five factors, from the saved table."""
    stored = sinks.load_factors(spark, _stored_factors(spark, sf_dir, [5]), k=5, side="b")
    return stored.select(F.col("id").cast("int").alias("row"), F.posexplode("loadings").alias("col0", "value")) \
        .select("row", (F.col("col0") + 1).alias("col"), "value")


@register("density_curves", with_proxies(_PANEL_SQL_BODY + """,
pd AS (SELECT meta, 'age' AS variable, age AS value FROM panel
       UNION ALL SELECT meta, 'par_diff', par_diff FROM panel
       UNION ALL SELECT meta, 'male', male FROM panel),
st0 AS (SELECT meta, variable, count(*) AS cnt, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1,
               quantile_cont(value, 0.75) AS q3, min(value) AS mn, max(value) AS mx
        FROM pd WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
st1 AS (SELECT *, CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
                       ELSE coalesce(CASE WHEN sd > 0 THEN sd END, CASE WHEN abs(mn) > 0 THEN abs(mn) END, 1.0) END AS losd
        FROM st0),
st2 AS (SELECT *, 0.9 * losd * pow(CAST(cnt AS DOUBLE), -0.2) AS bw FROM st1),
st3 AS (SELECT *, mn - 3.0 * bw AS xfrom, mx + 3.0 * bw AS xto FROM st2),
st4 AS (SELECT *, xfrom - 4.0 * bw AS lo, xto + 4.0 * bw AS up FROM st3),
st AS (SELECT *, (up - lo) / 511 AS dx FROM st4),
b0 AS (SELECT pd.meta, pd.variable, (value - lo) / dx AS p, 1.0 / cnt AS w
       FROM pd JOIN st ON st.meta = pd.meta AND st.variable = pd.variable WHERE value IS NOT NULL AND NOT isnan(value)),
bins AS (SELECT meta, variable, j, sum(m) AS m FROM (
           SELECT meta, variable, CAST(floor(p) AS INTEGER) AS j, w * (1.0 - (p - floor(p))) AS m FROM b0
           UNION ALL SELECT meta, variable, CAST(floor(p) AS INTEGER) + 1, w * (p - floor(p)) FROM b0) AS u
         WHERE j BETWEEN 0 AND 511 GROUP BY ALL),
grid AS (SELECT meta, variable, bw, lo, up, unnest(generate_series(0, 511)) AS i FROM st),
atg AS (SELECT g.meta, g.variable, g.i,
               greatest(sum(b.m * exp(-0.5 * pow(CAST(abs(g.i - b.j) AS DOUBLE) * (2.0 * (g.up - g.lo) / 1023) / g.bw, 2))
                        / (g.bw * sqrt(2 * pi()))), 0.0) AS d
        FROM grid g JOIN bins b ON b.meta = g.meta AND b.variable = g.variable GROUP BY ALL),
pts AS (SELECT meta, variable, lo, dx, xfrom + m * (xto - xfrom) / 511 AS x
        FROM (SELECT *, unnest(generate_series(0, 511)) AS m FROM st) AS s),
pts2 AS (SELECT *, (x - lo) / dx AS p FROM pts)
SELECT p.meta, p.variable, p.x,
       coalesce(a0.d, 0.0) * (1.0 - (p.p - floor(p.p))) + coalesce(a1.d, 0.0) * (p.p - floor(p.p)) AS y
FROM pts2 p
LEFT JOIN atg a0 ON a0.meta = p.meta AND a0.variable = p.variable AND a0.i = CAST(floor(p.p) AS INTEGER)
LEFT JOIN atg a1 ON a1.meta = p.meta AND a1.variable = p.variable AND a1.i = CAST(floor(p.p) AS INTEGER) + 1""",
                                           "p_tweet_counts", "p_infl", "p_clust_stats"),
          doubles=("x", "y"), ref="A18 U3")
def q_density_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel density of cluster age, par_diff and male per meta type (input of the ridge chart)."""
    long = frames.to_long(_panel(spark, sf_dir), ["meta"], ["age", "par_diff", "male"])
    return frames.density_curves(long, ["meta", "variable"], "value")


# =========================================================== model catalogue sequences
def _terms_times(a: list, b: list) -> list:
    """Interaction expansion of two term lists: every a, every b and every a:b."""
    out = list(a) + list(b)
    for x in a:
        for y in b:
            t = tuple(dict.fromkeys(x + y))
            if t not in out:
                out.append(t)
    return out


@register("binomial_model_sequence", None, ref="G5 G10 G2 (catalogue: base, +age, +poly(par_diff), +male, +log_n, full)")
def q_binomial_model_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x11 = _x11_rows(spark, sf_dir)
    base = star("issuepublic", "meta")
    extra = {"m1_age": [("age",), ("age", "issuepublic")],
             "m2_pardiff": [("par_diff",), ("par_diff", "issuepublic")],
             "m3_male": [("male",), ("male", "issuepublic")],
             "m4_log_n": [("log_n",), ("log_n", "issuepublic")]}
    full = base + [t for ts in extra.values() for t in ts]
    whole = make_design(x11, full, factors=["issuepublic", "meta"], levels={"issuepublic": ["blm", "pol"]}, poly=["par_diff"])
    x11 = _models.common_rows(x11, whole).persist()
    fits = {}
    for name, terms in [("base", base), *[(k, base + v) for k, v in extra.items()], ("full", full)]:
        d = make_design(x11, terms, factors=["issuepublic", "meta"], levels={"issuepublic": ["blm", "pol"]},
                        poly=["par_diff"])
        fits[name] = _glm.binomial_fit(x11, d, "v", "total")
    return _models.compare_models(spark, fits, {n: "base" for n in fits if n != "base"})


# =========================================================== small operators on their own
@register("pre_event_segments", "SELECT *, '+6' AS \"end\" FROM (\n" + REGISTRY["pooled_proportions"].sql
          + "\n) AS q WHERE t IN ('-2', '-1')", ref="U6 A11")
def q_pre_event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.pre_event_segments(REGISTRY["pooled_proportions"].fn(spark, sf_dir))


@register("display_names", with_proxies("""
SELECT CAST(strptime(date, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS day, 'y' || lpad(CAST(grp AS VARCHAR), 2, '0') AS cluster,
       CASE WHEN regex_type = 'blm' THEN 'BLM Public' ELSE 'Electoral Public' END AS public, CAST(sum(count) AS BIGINT) AS n
FROM p_tweet_counts WHERE regex_type <> 'total' GROUP BY ALL""", "p_tweet_counts"), ref="P15 F3 F10 A4")
def q_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts under display names: parsed day, zero-padded cluster, public."""
    t = P.tweet_counts(spark, sf_dir).where(F.col("regex_type") != "total")
    return (t.groupBy(columns.parse_day_key("date").alias("day"), columns.zero_pad_name("y", "grp", P.N_CLUSTERS).alias("cluster"),
                      columns.public_name("regex_type").alias("public")).agg(F.sum("count").cast("long").alias("n")))


@register("chosen_k", "WITH " + _ASSIGN_SQL + "\nSELECT id, k, grp FROM assign WHERE k = 32", ref="K3")
def q_chosen_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.select_k(_assignments(spark, sf_dir), 32)


@register("measure_ranges", with_proxies(_X11_SQL + """
SELECT issuepublic, min(age) AS age_min, max(age) AS age_max, min(par_diff) AS par_diff_min, max(par_diff) AS par_diff_max
FROM x11 GROUP BY issuepublic""", "p_infl", "p_clust_stats"),
          doubles=("age_min", "age_max", "par_diff_min", "par_diff_max"), ref="A15")
def q_measure_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the prediction grids, per issue public."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("age", "par_diff") for n, f in (("min", F.min), ("max", F.max))]
    return _x11(spark, sf_dir).groupBy("issuepublic").agg(*ends)


@register("level_grid", with_proxies("""
SELECT * FROM (SELECT DISTINCT regex_type FROM p_tweet_counts) AS a, (SELECT DISTINCT grp FROM p_tweet_counts) AS b,
              (SELECT DISTINCT is_rt FROM p_tweet_counts) AS c""", "p_tweet_counts"), ref="J9")
def q_level_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of the observed levels of the daily counts."""
    return _mixed.prediction_grid(P.tweet_counts(spark, sf_dir), ["regex_type", "grp", "is_rt"])


@register("account_correlations", "WITH f AS (\n" + REGISTRY["account_model_frame"].sql + """
)
SELECT var1, var2, r FROM (SELECT
  corr(cent_pop, cent_pardiff) AS r1, corr(cent_pop, cent_age) AS r2, corr(cent_pop, cent_male) AS r3,
  corr(cent_pop, approx_rw_centr) AS r4, corr(cent_pardiff, cent_age) AS r5, corr(cent_pardiff, cent_male) AS r6,
  corr(cent_pardiff, approx_rw_centr) AS r7, corr(cent_age, cent_male) AS r8, corr(cent_age, approx_rw_centr) AS r9,
  corr(cent_male, approx_rw_centr) AS r10 FROM f) c,
  LATERAL (VALUES ('cent_pop', 'cent_pardiff', r1), ('cent_pop', 'cent_age', r2), ('cent_pop', 'cent_male', r3),
           ('cent_pop', 'approx_rw_centr', r4), ('cent_pardiff', 'cent_age', r5), ('cent_pardiff', 'cent_male', r6),
           ('cent_pardiff', 'approx_rw_centr', r7), ('cent_age', 'cent_male', r8), ('cent_age', 'approx_rw_centr', r9),
           ('cent_male', 'approx_rw_centr', r10)) t(var1, var2, r)""",
          doubles=("r",), ref="A16 X12")
def q_account_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlations of the five predictors whose collinearity is checked."""
    return frames.correlation_matrix(REGISTRY["account_model_frame"].fn(spark, sf_dir),
                                     ["cent_pop", "cent_pardiff", "cent_age", "cent_male", "approx_rw_centr"])


@register("row_sample", with_proxies("""
SELECT id, grp, grp_val FROM p_accounts ORDER BY md5('587|' || id), id LIMIT 500""", "p_accounts"),
          doubles=("grp_val",), ref="U4")
def q_row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sample of 500 accounts (the sample size is the feature)."""
    return frames.sample_rows(P.accounts(spark, sf_dir).select("id", "grp", "grp_val"), 500, seed=587)


@register("saturated_fit", with_proxies(_X11_SQL + """
SELECT issuepublic, meta, sum(v * total) / sum(total) AS fitted, CAST(count(*) AS BIGINT) AS n
FROM x11 WHERE v IS NOT NULL AND total > 0 GROUP BY ALL""", "p_infl", "p_clust_stats"), doubles=("fitted",), ref="G5 G1")
def q_saturated_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted proportions of the saturated model issuepublic * meta, which have a closed form."""
    x11 = _x11_rows(spark, sf_dir).where(F.col("v").isNotNull() & (F.col("total") > 0))
    d = make_design(x11, star("issuepublic", "meta"), factors=["issuepublic", "meta"])
    fit = _glm.binomial_fit(x11, d, "v", "total")
    return (x11.select("issuepublic", "meta", fit.mu().alias("fitted"))
            .groupBy("issuepublic", "meta").agg(F.avg("fitted").alias("fitted"), F.count(F.lit(1)).alias("n")))


@register("fit_table", with_proxies(_X11_SQL + """,
cells AS (SELECT issuepublic, sum(v * total) / sum(total) AS p, sum(total) AS w FROM x11
          WHERE v IS NOT NULL AND total > 0 GROUP BY ALL),
ab AS (SELECT max(CASE WHEN issuepublic = 'blm' THEN ln(p / (1 - p)) END) AS a, max(CASE WHEN issuepublic = 'pol' THEN ln(p / (1 - p)) END) AS b,
              max(CASE WHEN issuepublic = 'blm' THEN 1 / (w * p * (1 - p)) END) AS va, max(CASE WHEN issuepublic = 'pol' THEN 1 / (w * p * (1 - p)) END) AS vb
       FROM cells)
SELECT '(Intercept)' AS term, a AS estimate, sqrt(va) AS std_error FROM ab
UNION ALL SELECT 'issuepublicpol', b - a, sqrt(va + vb) FROM ab""", "p_infl", "p_clust_stats"),
          doubles=("estimate", "std_error"), ref="G5 G9")
def q_fit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient table of a two-group logit: log-odds, their difference, and model-based errors."""
    x11 = _x11_rows(spark, sf_dir).where(F.col("v").isNotNull() & (F.col("total") > 0))
    d = make_design(x11, [("issuepublic",)], factors=["issuepublic"], levels={"issuepublic": ["blm", "pol"]})
    return _glm.coef_table(spark, _glm.binomial_fit(x11, d, "v", "total")).select("term", "estimate", "std_error")


@register("clustered_errors", with_proxies(_X11_SQL + """,
r AS (SELECT grp, issuepublic, total, v FROM x11 WHERE v IS NOT NULL AND total > 0),
m AS (SELECT sum(v * total) / sum(total) AS p, sum(total) AS w FROM r),
u AS (SELECT grp, sum(total * (v - p)) AS s FROM r, m GROUP BY grp)
SELECT ln(any_value(p) / (1 - any_value(p))) AS estimate,
       sqrt(sum(s * s) * count(*) / (count(*) - 1.0)) / (any_value(w) * any_value(p) * (1 - any_value(p))) AS std_error
FROM u, m""", "p_infl", "p_clust_stats"), doubles=("estimate", "std_error"), ref="G8 G9")
def q_clustered_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled log-odds with its cluster-robust standard error, which have a closed form."""
    x11 = _x11_rows(spark, sf_dir).where(F.col("v").isNotNull() & (F.col("total") > 0))
    fit = _glm.binomial_fit(x11, make_design(x11, []), "v", "total")
    return _glm.coef_table(spark, fit, _glm.cluster_vcov(fit, x11, "grp")).select("estimate", "std_error")


@register("fe_level_fit", "WITH f AS (\n" + REGISTRY["account_model_frame"].sql + "\n)\n" + """
SELECT grp, sum(value) / sum(total) AS fitted, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY grp
HAVING sum(value) > 0 AND sum(value) < sum(total)""", doubles=("fitted",), ref="G6 G14")
def q_fe_level_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted values of a model with cluster effects only: each cluster's pooled proportion;
    clusters without variation are dropped."""
    df = _x12(spark, sf_dir)
    fit = _models.fe_binomial_fit(df, make_design(df, []), "v", "total", ["grp"])
    kept = df.where(F.col("grp").cast("string").isin(fit.design.factors["grp"]))
    return kept.groupBy("grp").agg(F.avg(fit.mu()).alias("fitted"), F.count(F.lit(1)).alias("n"))


from ..stats import absorb as _absorb  # noqa: E402


def _account_fit(df: DataFrame):
    """Crossed effects of the issue public and of every account: the latter grow with the accounts."""
    terms = [("cent_pop", "variable"), ("cent_age", "variable")]
    return _absorb.absorbed_binomial_fit(df, make_design(df, terms, factors=["variable"]), "v", "total", ["variable", "id"])


@register("fe_account_fit", None, ref="G6 G9")
def q_fe_account_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes within accounts: v ~ (cent_pop + cent_age):variable | variable + id."""
    return _glm.coef_table(spark, _account_fit(_x12(spark, sf_dir)))


@register("fe_account_totals", "WITH f AS (\n" + REGISTRY["account_model_frame"].sql + "\n)\n" + """
SELECT id, CAST(sum(value) AS DOUBLE) AS fitted, CAST(count(*) AS BIGINT) AS n FROM f
WHERE cent_pop IS NOT NULL AND cent_age IS NOT NULL GROUP BY id
HAVING sum(value) > 0 AND sum(value) < sum(total)""", doubles=("fitted",), ref="G6 G14")
def q_fe_account_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted totals of every account under the model with account effects: the observed ones, by its score equations."""
    df = _x12(spark, sf_dir)
    return (_account_fit(df).fitted(df).groupBy("id")
            .agg(F.round(F.sum(F.col("fitted") * F.col("total")), 3).alias("fitted"), F.count(F.lit(1)).alias("n")))


from . import layouts  # noqa: E402,F401  (queries through the source layouts register themselves)
