"""Explicit schemas for every source; ids are LONG, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Only the tweet fields the keyword-count job reads (nested schema pruning
# keeps the JSON scan to these paths).
TWEET = _struct(
    ("id_str", S),
    ("created_at", S),
    ("text", S),
    ("extended_tweet", _struct(("full_text", S))),
    ("user", _struct(("id", L), ("id_str", S))),
    ("in_reply_to_user_id", L),
    ("quoted_status", _struct(("id_str", S))),
    ("retweeted_status", _struct(("id_str", S), ("text", S),
                                 ("extended_tweet", _struct(("full_text", S))))),
)

# Raw CSV columns arrive as text and are cast with try_cast afterwards.
INFLUENCERS_RAW = _struct(("uid", S), ("grp", S))
EDGES_RAW = _struct(("source", S), ("target", S), ("attr", S))

INFLUENCERS = _struct(("uid", L), ("grp", I))
EDGES = _struct(("source", L), ("target", L), ("attr", I))

CLUSTER_LABELS = _struct(("k", I), ("Label", S), ("narrow_label", S), ("meta", S), ("Metalabel1", S))

PANEL = _struct(("twProfileID", L), ("voterbase_age", I), ("voterbase_gender", S),
                ("voterbase_race", S), ("tsmart_partisan_score", D))

# 19 positional names of the header-less panel profile TSV.
PANEL_PROFILE_NAMES = ("uid", "name", "screen_name", "url", "protected", "location", "description",
                       "followers_count", "friends_count", "created_at", "utc_offset", "time_zone",
                       "statuses_count", "lang", "status_created_at", "status_coordinates",
                       "status_lang", "profile_image_url_https", "verified")
PANEL_PROFILES = _struct(*[(n, S) for n in PANEL_PROFILE_NAMES])

ASSIGNMENT = _struct(("id", L), ("grp", I))

TWEET_COUNTS = _struct(("date", S), ("grp", I), ("userid", L), ("count", L),
                       ("regex_type", S), ("is_rt", B))

USER_DETAILS = _struct(("id", S), ("username", S), ("description", S), ("expanded_url", S),
                       ("pinned_tweet_text", S), ("location", S), ("followers_count", L),
                       ("following_count", L), ("tweet_count", L), ("verified", B))

LOADINGS = T.StructType([T.StructField("id", L, False), T.StructField("k", I, False),
                         T.StructField("loadings", T.ArrayType(D, False), False)])
