"""Join helpers: membership and lookup joins.

No side is hinted: Spark broadcasts a side whose size in bytes is below
``spark.sql.autoBroadcastJoinThreshold``, by its statistics when planning and
by the measured size at run time (AQE), and shuffles beyond it. No job runs
while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def restrict_to(df: DataFrame, ids: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Rows whose key is in ``ids`` (left semi join; duplicates in ids do not multiply)."""
    right_key = right_key or left_key
    keys = ids.select(F.col(right_key).alias("__k")).distinct()
    return df.join(keys, df[left_key] == keys["__k"], "left_semi")


def exclude(df: DataFrame, ids: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Rows whose key is not in ``ids`` (left anti join, null safe unlike NOT IN)."""
    right_key = right_key or left_key
    keys = ids.select(F.col(right_key).alias("__k"))
    return df.join(keys, df[left_key] == keys["__k"], "left_anti")


def attach(df: DataFrame, other: DataFrame, left_key: str, right_key: str | None = None,
           how: str = "inner") -> DataFrame:
    """Keyed lookup join with explicit keys; the right key is dropped."""
    right_key = right_key or left_key
    if right_key == left_key:
        return df.join(other, left_key, how)
    return df.join(other, df[left_key] == other[right_key], how).drop(other[right_key])
