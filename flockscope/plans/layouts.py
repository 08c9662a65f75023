"""Queries that go through files: inputs in their source layouts, readers S1-S9, sinks K1 and K2.

Each query derives its input from the driver tables, writes it in the layout
the analysed pipeline reads (with some unreadable lines, made of rows of the
tables), and reads it back; the SQL works on the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import counts, network
from ..session import ensure_checkpoint_dir
from ..sources import readers, schemas, sinks
from . import proxies as P
from .catalog import register
from .oracle import with_proxies


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/layout-{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, path: str) -> str:
    df.write.text(path)
    return path


def _json_tweets(spark: SparkSession, sf_dir: str) -> str:
    """Tweets as gzipped JSON lines; every account's id also stands in a line that breaks off."""
    lines = P.tweets(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    broken = P.accounts(spark, sf_dir).select(F.format_string('{"id_str": "%d", "user": {', "id").alias("value"))
    path = _folder(spark, "tweets")
    lines.unionByName(broken).write.option("compression", "gzip").text(path)
    return path


@register("tweets_from_json", with_proxies("""
SELECT CAST(id_str AS VARCHAR) AS id_str, user_id AS userid,
       strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS date, retweeted_id IS NOT NULL AS is_rt,
       length(coalesce(short_text, extended_text)) AS text_chars
FROM p_tweets WHERE quoted_id IS NULL AND reply_user IS NULL""", "p_tweets"), ref="S1 P1 P2 P3")
def q_tweets_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets = readers.read_tweets(spark, _json_tweets(spark, sf_dir), metrics=Observation())
    return counts.project_tweets(tweets).select("id_str", "userid", "date", "is_rt", F.length("text").alias("text_chars"))


def _csv_influencers(spark: SparkSession, sf_dir: str) -> str:
    """Top accounts, space-separated; every supplier adds a row whose id is no number."""
    rows = P.influencers(spark, sf_dir).select(F.col("uid").cast("string"), F.col("grp").cast("int"))
    bad = P.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("uid"), F.lit(1).alias("grp"))
    path = _folder(spark, "influencers")
    sinks.write_csv(rows.unionByName(bad.withColumn("uid", F.translate("uid", " ", "_"))), path, sep=" ")
    return path


def _csv_edges(spark: SparkSession, sf_dir: str) -> str:
    """Follows with an attribute; every nation adds an edge without a target."""
    rows = P.follows(spark, sf_dir).select(F.col("source").cast("string"), F.col("target").cast("string"), F.lit(1).alias("attr"))
    bad = P.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("source"), F.lit(None).cast("string").alias("target"),
                                                 F.lit(1).alias("attr"))
    path = _folder(spark, "edges")
    sinks.write_csv(rows.unionByName(bad), path)
    return path


@register("group_counts_from_csv", with_proxies("SELECT source, grp, count FROM p_net", "p_net"), ref="S2 S3 K2 A2 J2")
def q_group_counts_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows per panelist and cluster, from an edge list and an account list in files."""
    return counts.user_group_counts(readers.read_edges(spark, _csv_edges(spark, sf_dir)),
                                    readers.read_influencers(spark, _csv_influencers(spark, sf_dir)))


def _numbered_ids(spark: SparkSession, ids: DataFrame, name: str) -> str:
    """An id file: one id a line, in order (the sort makes the files of the folder follow each other)."""
    return _lines(ids.orderBy("id").select(F.col("id").cast("string").alias("value")), _folder(spark, name))


def _matrix_market(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """The follow matrix: panelists' and accounts' id files, and entries of line numbers.

    Every nation adds an entry that is no pair of numbers, every region one
    whose row lies beyond the id file.
    """
    rows = _numbered_ids(spark, P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "rows")
    cols = _numbered_ids(spark, P.accounts(spark, sf_dir).select("id"), "cols")
    place = lambda path, key, at: readers.numbered_lines(spark, path).select(
        F.col("value").cast("long").alias(key), F.col("pos").alias(at))
    r, c = place(rows, "source", "i"), place(cols, "target", "j")
    body = P.follows(spark, sf_dir).join(r, "source").join(c, "target").select(F.lit(1).alias("part"), F.concat_ws(" ", "i", "j").alias("value"))
    far = r.agg(F.max("i").alias("n_rows")).first()["n_rows"] or 0
    bad = P.table(spark, sf_dir, "nation").select(F.lit(1).alias("part"), F.concat(F.lit("x "), "n_nationkey").alias("value"))
    beyond = P.table(spark, sf_dir, "region").select(F.lit(1).alias("part"), F.concat_ws(" ", F.col("r_regionkey") + far + 1, F.lit(1)).alias("value"))
    head = spark.range(1).select(F.lit(0).alias("part"), F.explode(F.array(
        F.lit("%%MatrixMarket matrix coordinate pattern general"), F.concat_ws(" ", F.lit(far), F.lit(far), F.lit(0)))).alias("value"))
    every = head.unionByName(body).unionByName(bad).unionByName(beyond)
    return _lines(every.orderBy("part", F.desc(F.startswith("value", F.lit("%"))), "value").select("value"), _folder(spark, "matrix")), rows, cols


@register("matrix_market_edges", with_proxies("SELECT source, target FROM p_follows", "p_follows"), ref="S6")
def q_matrix_market_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_mm_edges(spark, *_matrix_market(spark, sf_dir))


@register("scan_rejects", with_proxies("""
SELECT 'edges' AS source, (SELECT count(*) FROM p_follows) + (SELECT count(*) FROM nation) AS n_rows, (SELECT count(*) FROM nation) AS n_rejected
UNION ALL SELECT 'influencers', (SELECT count(*) FROM p_influencers) + (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier)
UNION ALL SELECT 'matrix', (SELECT count(*) FROM p_follows) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region),
  (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)
UNION ALL SELECT 'tweets', (SELECT count(*) FROM p_tweets) + (SELECT count(*) FROM part), (SELECT count(*) FROM part)""",
                                       "p_follows", "p_influencers", "p_tweets"), ref="S1 S2 S3 S6")
def q_scan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read and rejected per source, counted by the scans that read them."""
    reads = {"edges": lambda m: readers.read_edges(spark, _csv_edges(spark, sf_dir), m),
             "influencers": lambda m: readers.read_influencers(spark, _csv_influencers(spark, sf_dir), m),
             "matrix": lambda m: readers.read_mm_edges(spark, *_matrix_market(spark, sf_dir), m),
             "tweets": lambda m: readers.read_tweets(spark, _json_tweets(spark, sf_dir), metrics=m)}
    found = []
    for name, read in reads.items():
        seen = Observation()
        read(seen).write.format("noop").mode("overwrite").save()
        found.append(F.struct(F.lit(name).alias("source"), *[F.lit(seen.get[c]).cast("long").alias(c) for c in ("n_rows", "n_rejected")]))
    return spark.range(1).select(F.inline(F.array(*found)))


@register("profiles_from_tsv", """
SELECT CAST(p_partkey AS VARCHAR) AS uid, p_name || ' ' || p_type AS name, p_brand AS location,
       CAST(p_size * 100 AS VARCHAR) AS followers_count, CASE WHEN p_type = 'PROMO' THEN 'true' ELSE 'false' END AS verified
FROM part""", ref="S8")
def q_profiles_from_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account profiles as a header-less file of 19 fields, with NUL characters in the names."""
    a = P.accounts(spark, sf_dir)
    given = {"uid": F.col("id"), "name": F.concat("username", F.lit("\0"), "description"), "location": F.col("location"),
             "followers_count": F.col("followers_count"), "verified": F.col("verified")}
    fields = [given.get(n, F.lit("")).cast("string") for n in schemas.PANEL_PROFILE_NAMES]
    path = _lines(a.select(F.concat_ws("\t", *fields).alias("value")), _folder(spark, "profiles"))
    return readers.read_profiles(spark, path).select("uid", "name", "location", "followers_count", "verified")


@register("assignments_from_csv", """
SELECT vec_id AS id, k, CAST(list_position(l, list_max(l)) AS INTEGER) AS grp
FROM (SELECT vec_id, k, list_transform(range(k), lambda i: list_sum(list_slice(CAST(embedding AS DOUBLE[]), i * (64 // k) + 1, (i + 1) * (64 // k)))) AS l
      FROM embeddings, (VALUES (16), (32), (64)) AS ks(k)) AS s""", ref="S9 K2 K3")
def q_assignments_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster assignments, a ``y_<k>.csv`` per setting, k taken from the name."""
    given, root = network.assign_clusters(P.loadings(spark, sf_dir)).select("id", "k", "grp"), _folder(spark, "assignments")
    for k in (16, 32, 64):
        sinks.write_csv(sinks.select_k(given, k).select("id", "grp"), f"{root}/y_{k}.csv")
    return readers.read_assignments(spark, f"{root}/y_*.csv").select("id", "k", "grp")


@register("stored_counts", with_proxies("""
SELECT userid, grp, regex_type, is_rt, CAST(sum(count) AS BIGINT) AS count FROM p_tweet_counts GROUP BY ALL""", "p_tweet_counts"), ref="K1 S5 S7 A6")
def q_stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts stored by list and kind, once as Parquet and once as text, read back and added up."""
    path, given = _folder(spark, "counts"), P.tweet_counts(spark, sf_dir)
    sinks.write_counts(given, path)
    stored = readers.read_parquet_text_clean(spark, path, ["date"])
    sinks.write_csv(stored.select(*schemas.TWEET_COUNTS.names), f"{path}-text")
    back = readers.read_table(spark, f"{path}-text", schemas.TWEET_COUNTS)
    return back.groupBy("userid", "grp", "regex_type", "is_rt").agg(F.sum("count").alias("count"))
