"""Stand-ins for the analysed pipeline's inputs, built from the driver tables.

The analysed inputs (tweets, follow graph, voter panel, cluster labels ...)
are not distributable, so every registered query reads the driver's
TPC-H-like tables and derives the logical tables below with Spark. Entities:

* accounts / influencers (followed side)  <- ``part``
* panelists (following side)              <- ``customer``
* follow edges                            <- ``orders`` x ``lineitem`` (distinct customer -> part)
* tweets (nested JSON shape)              <- ``events`` x ``documents`` (every event, documents in turn, whole text)
* daily keyword counts                    <- ``lineitem`` per (ship day, part): total / R / A flags
* cluster labels                          <- ``nation`` x ``region`` (25 clusters)
* loadings                                <- ``embeddings`` (64 loadings per id)

Every proxy grows with its source tables; none samples or caps rows.
The same definitions are written in DuckDB SQL in :mod:`flockscope.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import recode_meta
from ..operators import audience, counts, network
from ..session import spread

N_CLUSTERS = 25
# Focal dates of the two events for the lineitem-based daily counts.
EVENT_CUTS = (("1998-06-01", "Event A"), ("1999-11-03", "Event B"))
# Influencers kept per cluster: the analysed pipeline's 3,500.
TOP_PER_CLUSTER = 3500
# Accounts per cluster on the annotation sheet.
ANNOTATE_PER_CLUSTER = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested tweets: one per event, which takes the document of its id modulo the number of documents."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    # events take the documents in turn, so every row of both tables is used
    n_docs = docs.count()
    j = ev.join(docs, F.pmod("event_id", F.lit(n_docs)) == docs.doc_id, "inner")
    sid = F.col("event_id").cast("string")
    short = F.when(F.col("n_chars") <= 280, F.col("text"))
    is_rt = F.col("event_type").isin("click", "purchase")
    quoted = F.col("event_type") == "error"
    reply = (F.col("event_type") == "signup") | (F.col("value") > 400)
    return j.select(
        sid.alias("id_str"),
        F.date_format("ts", "EEE MMM dd HH:mm:ss +0000 yyyy").alias("created_at"),
        short.alias("text"),
        F.struct(F.col("text").alias("full_text")).alias("extended_tweet"),
        F.struct(F.col("user_id").alias("id"), F.col("user_id").cast("string").alias("id_str")).alias("user"),
        F.when(reply, F.col("user_id")).alias("in_reply_to_user_id"),
        F.when(quoted, F.struct(sid.alias("id_str"))).alias("quoted_status"),
        F.when(is_rt, F.struct(sid.alias("id_str"), short.alias("text"),
                               F.struct(F.col("text").alias("full_text")).alias("extended_tweet")))
         .alias("retweeted_status"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followed accounts with cluster assignment, loading strength and profile."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        (F.col("p_size") % N_CLUSTERS).cast("int").alias("grp"),
        F.col("p_retailprice").alias("grp_val"),
        F.col("p_name").alias("username"),
        F.col("p_type").alias("description"),
        F.col("p_brand").alias("location"),
        (F.col("p_size") * 100).cast("long").alias("followers_count"),
        F.col("p_size").cast("long").alias("following_count"),
        (F.col("p_type") == "PROMO").alias("verified"),
    )


def account_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with the further profile fields of the annotation sheet."""
    more = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("https://example.org/"), F.col("p_brand")).alias("expanded_url"),
        F.concat_ws(" ", "p_name", "p_type").alias("pinned_tweet_text"), (F.col("p_size") * 7).cast("long").alias("tweet_count"))
    return accounts(spark, sf_dir).join(more, "id")


def influencers(spark: SparkSession, sf_dir: str, n: int = TOP_PER_CLUSTER) -> DataFrame:
    """(uid, grp): the top-n accounts per cluster by loading."""
    top = network.top_per_cluster(accounts(spark, sf_dir), n)
    return top.select(F.col("id").alias("uid"), "grp")


def _follow_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> part of every line of an order, as often as it was ordered."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (spread(o, "o_orderkey").join(spread(li, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
            .select(F.col("o_custkey").alias("source"), F.col("l_partkey").alias("target")))


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_follow_pairs(spark, sf_dir), "source", "target").distinct()


def planted_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows with a community structure that a spectral method can find.

    To the follows of ``follows`` every customer adds 24 accounts: 16 of its own
    nation's block (parts by key modulo 25) and 8 of any block of its group of
    five nations. Drawn by hash, so linear in the customers.
    """
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"))
    per_block = F.greatest(F.floor(F.lit(parts.count()) / N_CLUSTERS), F.lit(1))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("j"))
    near = F.floor(F.col("c_nationkey") / 5) * 5 + F.pmod(F.xxhash64(F.lit("block"), "c_custkey", "j"), F.lit(5))
    block = F.when(F.col("j") < 16, F.col("c_nationkey")).otherwise(near)
    place = F.pmod(F.xxhash64(F.lit("place"), "c_custkey", "j"), per_block)
    added = c.select(F.col("c_custkey").cast("long").alias("source"), (block + N_CLUSTERS * place).cast("long").alias("target"))
    old = _follow_pairs(spark, sf_dir).select(F.col("source").cast("long"), F.col("target").cast("long"))
    both = old.union(added.join(parts, "target", "left_semi").select("source", "target"))
    return spread(both, "source", "target").distinct()  # once, for the follows and the added ones


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    meta1 = (F.when(F.col("r_name") == "AFRICA", "Political").when(F.col("r_name") == "AMERICA", "Local")
              .when(F.col("r_name") == "ASIA", "Sports").when(F.col("r_name") == "EUROPE", "Celeb/Influencer")
              .otherwise("News"))
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").alias("k"),
                    F.when(F.col("n_nationkey") % 7 == 3, F.concat(F.lit("Non-US "), F.col("n_name")))
                     .otherwise(F.col("n_name")).alias("Label"),
                    F.when(F.col("n_nationkey") % 9 == 0, F.lit("No Clear Pattern"))
                     .otherwise(F.col("r_name")).alias("narrow_label"),
                    recode_meta(meta1).alias("meta"),
                    meta1.alias("Metalabel1")))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    race = (F.when(k % 5 == 0, "Caucasian").when(k % 5 == 1, "African-American")
             .when(k % 5 == 2, "Uncoded").when(k % 5 == 3, "Hispanic").otherwise("Other"))
    return c.select(
        k.alias("twProfileID"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(18 + k % 70).cast("int").alias("voterbase_age"),
        F.when(k % 2 == 0, "Male").otherwise("Female").alias("voterbase_gender"),
        race.alias("voterbase_race"),
        ((k * 37) % 100).cast("double").alias("tsmart_partisan_score"),
    )


def panel_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z: panelist cluster assignment."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"),
                                                    F.col("c_nationkey").alias("grp"))


def panel_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"),
                    F.lower("c_name").alias("screen_name"), F.col("c_mktsegment").alias("description"),
                    F.col("c_acctbal").cast("long").alias("followers_count"))


def tweet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily (date, grp, userid, is_rt, regex_type, count) from lineitem ship days."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag", "l_linestatus")
    acc = accounts(spark, sf_dir).select(F.col("id").alias("l_partkey"), "grp")
    # grouped by the second, which the day key names; hardly a key comes twice, so rows are dealt before they are counted
    rows = li.join(acc, "l_partkey").select(
        F.date_trunc("second", "l_shipdate").alias("second"), "grp", F.col("l_partkey").alias("userid"),
        (F.col("l_linestatus") == "O").alias("is_rt"), (F.col("l_returnflag") == "R").alias("r"), (F.col("l_returnflag") == "A").alias("a"))
    wide = (spread(rows, "userid", "second", "is_rt").groupBy("second", "grp", "userid", "is_rt")
            .agg(F.count(F.lit(1)).alias("total"), F.count_if("r").alias("pol"), F.count_if("a").alias("blm"))
            .select(F.date_format("second", "yyyy-MM-dd HH:mm:ss").alias("date"), "grp", "userid", "is_rt", "total", "pol", "blm"))
    return counts.to_long_counts(wide, ["total", "pol", "blm"])


def infl_w_tweet_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts + labels + per-account pol / blm / total."""
    return counts.influencer_tweet_totals(accounts(spark, sf_dir), tweet_counts(spark, sf_dir),
                                          labels(spark, sf_dir))


def clust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster audience statistics (A9) from follows, top influencers and panel."""
    net = counts.user_group_counts(follows(spark, sf_dir), influencers(spark, sf_dir))
    return audience.cluster_audience_stats(net, panel(spark, sf_dir), labels(spark, sf_dir))


def infl_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audience.influencer_audience(follows(spark, sf_dir), panel(spark, sf_dir))


def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"),
                                               (F.col("p_retailprice") / 1000.0).alias("approx_rw_centr"))


def new_bios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshed profiles for one brand of accounts (RFC-style created_at)."""
    p = table(spark, sf_dir, "part").where(F.col("p_brand") == "Brand#13")
    created = F.date_format(F.timestamp_add("DAY", F.col("p_size"), F.lit("2020-01-01 00:00:00").cast("timestamp")),
                            "EEE, dd MMM yyyy HH:mm:ss +0000")
    return p.select(F.col("p_partkey").alias("uid"), F.upper("p_name").alias("screen_name"),
                    F.concat(F.lit("acct/"), F.col("p_partkey").cast("string")).alias("url"),
                    created.alias("created_at"), F.col("p_type").alias("description"))


K_SETTINGS = (16, 32, 64)


def loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, k, loadings): for every k the 64 values of a vector summed into k neighbouring groups."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    size = lambda k: 64 // k
    part = lambda k: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.aggregate(
        F.slice("e", i * size(k) + 1, F.lit(size(k))), F.lit(0.0), lambda s, x: s + x))
    settings = F.array(*[F.struct(F.lit(k).alias("k"), part(k).alias("loadings")) for k in K_SETTINGS])
    return e.select("id", F.inline(settings))


def label_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A further labeling of the same ids, as setting 0."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("k"), F.col("label").alias("grp"))
