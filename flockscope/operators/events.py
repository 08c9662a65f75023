"""Event-relative weekly series.

All events are binned in one pass: each daily row becomes one (event, bin)
row per event whose window covers it, then a single aggregation produces
list counts and the per-bin total side by side (conditional aggregation
instead of the part-vs-total self join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import agresti_coull, event_bin_index, event_bin_label, is_excluded_cluster
from .counts import cluster_daily_counts
from .network import one_per_group


def event_window(daily: DataFrame, events: Sequence[tuple[str, str]],
                 lists: Sequence[str] = ("pol", "blm")) -> DataFrame:
    """(grp, t, t_idx, regex_type, polcnt, total, event) for every event.

    ``daily``: (regex_type, grp, date, count) with 'total' rows among the
    regex types. Days with -22 < d < 49 relative to each cut are binned (bin 0
    covers two weeks). A (grp, bin) without a total row is dropped, and a list
    with no matches in a bin is absent rather than 0.
    """
    per_event = F.array(*[F.struct(F.lit(name).alias("event"), event_bin_index("date", cut).alias("t_idx"))
                          for cut, name in events])
    binned = (daily.select("grp", "regex_type", "count", F.inline(per_event))
              .where(F.col("t_idx").isNotNull()))
    rt = F.col("regex_type")
    wide = binned.groupBy("grp", "event", "t_idx").agg(
        F.sum(F.when(rt == "total", F.col("count"))).alias("total"),
        *[F.sum(F.when(rt == name, F.col("count"))).alias(name) for name in lists])
    long = (wide.where(F.col("total").isNotNull())
            .unpivot(["grp", "event", "t_idx", "total"], list(lists), "regex_type", "polcnt")
            .where(F.col("polcnt").isNotNull()))
    return long.select("grp", event_bin_label("t_idx").alias("t"), "t_idx", "regex_type",
                       F.col("polcnt").cast("long").alias("polcnt"), F.col("total").cast("long").alias("total"),
                       "event")


def drop_non_publics(df: DataFrame) -> DataFrame:
    """Drop clusters whose Label matches the exclusion pattern or that have no clear pattern."""
    return df.where(~is_excluded_cluster("Label", "narrow_label"))


def cluster_event_panel(counts: DataFrame, infl: DataFrame, stats: DataFrame,
                        events: Sequence[tuple[str, str]], since: str | None = None,
                        lists: Sequence[str] = ("pol", "blm")) -> DataFrame:
    """Cluster x event x week panel with labels, exclusions and audience stats.

    ``counts``: daily tweet counts; ``infl``: accounts with (id, grp, Label,
    narrow_label, meta); ``stats``: cluster audience statistics (A9).
    """
    daily = cluster_daily_counts(counts, accounts=infl.select("id"), since=since)
    rq = event_window(daily, events, lists)
    lab = one_per_group(infl.select("grp", "id", "Label", "narrow_label", "meta"), "grp", "id").drop("id")
    rq = drop_non_publics(rq.join(lab, "grp", "inner"))
    rq = rq.join(stats, "grp", "inner")
    return rq.withColumn("par_diff", F.col("rep") - F.col("dem"))


def pooled_proportions(panel: DataFrame, z: float | None = None,
                       by: Sequence[str] = ("t", "event", "regex_type")) -> DataFrame:
    """Pooled x / n per (t, event, regex_type) with an Agresti-Coull 95 % interval."""
    agg = panel.groupBy(*by).agg(F.sum("polcnt").cast("long").alias("x"), F.sum("total").cast("long").alias("n"))
    ci = agresti_coull("x", "n") if z is None else agresti_coull("x", "n", z)
    return agg.withColumns(ci)


def pre_event_segments(pred: DataFrame, end: str = "+6") -> DataFrame:
    """Rows at t in {-2, -1} carried to the end of the window."""
    return pred.where(F.col("t").isin("-2", "-1")).withColumn("end", F.lit(end))
