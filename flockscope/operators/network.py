"""Follow-graph operators: pruning, top accounts, attention, membership.

Edges are ``(source, target)``: source = panelist, target = followed account.
No positional matrix is ever built; real ids travel with every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import profile_link, rfc_time, row_argmax, row_max
from ..session import spread
from .joins import exclude


def prune_follows(edges: DataFrame, min_followers: int = 25, min_follows: int = 10) -> DataFrame:
    """M1: keep accounts with >= min_followers, then panelists with >= min_follows kept accounts.

    One pass each, no fixpoint (an account may end below ``min_followers``).
    Counts are windows, so the edges are derived once and dealt once by account
    and once by panelist; joins with the kept keys would derive them four times.
    """
    followers = F.count(F.lit(1)).over(Window.partitionBy("target"))
    follows = F.count(F.lit(1)).over(Window.partitionBy("source"))
    e = spread(edges.select("source", "target").where("target IS NOT NULL"), "target")
    e1 = e.withColumn("__n", followers).where(F.col("__n") >= min_followers).select("source", "target")
    e2 = spread(e1.where("source IS NOT NULL"), "source")
    return e2.withColumn("__n", follows).where(F.col("__n") >= min_follows).select("source", "target")


def attention_share(net: DataFrame, count_col: str = "count", by: str = "source") -> DataFrame:
    """Count / sum(count) within a panelist (<= one row per cluster each, so no skew)."""
    w = Window.partitionBy(by)
    return net.withColumn("prop", F.col(count_col) / F.sum(count_col).over(w))


def top_per_cluster(y: DataFrame, n: int, grp: str = "grp", val: str = "grp_val", id_col: str = "id",
                    slices: int = 32) -> DataFrame:
    """At most n rows per cluster by descending loading, ties by id.

    Two steps: the top n of every (cluster, slice), with the cluster dealt into
    ``slices`` by an id hash, then the top n of what is left. A cluster that
    holds a third of all accounts is sorted by many tasks, and the last step
    sees at most ``slices * n`` rows of a cluster.
    """
    best = (F.col(val).desc(), F.col(id_col).asc())
    dealt = y.withColumn("_slice", F.pmod(F.xxhash64(id_col), F.lit(slices)))
    part = Window.partitionBy(grp, "_slice").orderBy(*best)
    few = dealt.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_slice")
    return few.withColumn("_rn", F.row_number().over(Window.partitionBy(grp).orderBy(*best))).where(F.col("_rn") <= n).drop("_rn")


def annotation_sheet(y: DataFrame, n: int = 50,
                     fields: tuple[str, ...] = ("username", "description", "expanded_url", "pinned_tweet_text", "location",
                                                "followers_count", "following_count", "tweet_count",
                                                "verified")) -> DataFrame:
    """Top n accounts per cluster with profile fields, a profile link and k = cluster.

    Within its own cluster an account's loading on that cluster is its maximum
    loading (``grp_val``), so ranking by ``grp_val`` is ranking by the cluster
    column. Clusters under n rows are not padded with empty rows.
    """
    top = top_per_cluster(y, n)
    return top.select(*fields, profile_link(F.col("id")).alias("url"), F.col("grp").alias("k"))


def top_influencer_edges(edges: DataFrame, top: DataFrame) -> DataFrame:
    """M6: edges whose target is a top account (semi join; the top list is cluster-bounded)."""
    keys = top.select(F.col("uid").alias("target")).distinct()
    return edges.join(keys, "target", "left_semi").select("source", "target")


def assign_clusters(loadings: DataFrame, keep: tuple[str, ...] = ("id", "k"), col: str = "loadings") -> DataFrame:
    """Argmax cluster (1-based, first maximum) and max loading of every row.

    One row per id and setting k, each with its own loadings: a solution for k
    clusters is not the first k columns of one for more.
    """
    return loadings.select(*keep, row_argmax(col).alias("grp"), row_max(col).alias("grp_val"))


def one_per_group(df: DataFrame, by: str, order: str) -> DataFrame:
    """The first row per group under an explicit order."""
    w = Window.partitionBy(by).orderBy(F.col(order).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def merge_new_bios(infl: DataFrame, bios: DataFrame, labels: DataFrame) -> DataFrame:
    """Refreshed profiles replace old rows, then labels (inner) and lower-cased name.

    New bios only count for accounts in ``infl`` (their grp / grp_val are taken
    from there); missing columns on either side become NULL.
    """
    nb = (bios.withColumnsRenamed({"uid": "id", "screen_name": "username", "url": "expanded_url"})
          .withColumn("created_at", rfc_time("created_at")))
    nb = nb.join(infl.select("id", "grp", "grp_val"), "id", "inner")
    kept = exclude(infl, nb, "id")
    merged = kept.unionByName(nb, allowMissingColumns=True)
    lab = labels.select(F.col("k").alias("grp"), *[c for c in labels.columns if c != "k"])
    return merged.join(lab, "grp", "inner").withColumn("sn_lower", F.lower("username"))


def panel_frame(panel: DataFrame, z: DataFrame, labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Panel demographics x (assignment left-join labels) x profiles."""
    lab = labels.select(F.col("k").alias("grp"), *[c for c in labels.columns if c != "k"])
    zc = z.join(lab, "grp", "left")
    p = panel.join(zc, panel["twProfileID"] == zc["id"], "inner").drop("id")
    return p.join(profiles, p["twProfileID"] == profiles["uid"], "inner").drop("uid")
