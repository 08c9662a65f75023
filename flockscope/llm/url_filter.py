"""Operator 3 - URL filters by a sort-merge range join (DataFrame only).

A host reversed label by label (``www.example.net`` -> ``net.example.www.``)
starts with the reversed rule host exactly if the rule fits the host, so every
rule is an interval of sorted keys, and intervals nest or are apart. The sweep
sorts keys and interval ends together and carries the stack of rules that are
open: an interval's start pushes, its end pops, and a key's rules are the last
stack before it. It runs on range partitions; each is told the stack that is
open where it begins.

Two sweeps answer a URL: over distinct hosts, the rule hosts that fit; over
distinct (rule host, path) pairs, the longest rule path that begins the path.
Distinct keys are pre-aggregated before every shuffle, so a host with a third
of all pages is one key; only the last join meets its pages, where Spark splits
a hot side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockscope.llm.common import boxed, let, write_shared

#: Fixed values of the contract: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), AZ, AZ.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot; an empty host stays empty."""
    labels = F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")
    return F.when(host == "", F.lit("")).otherwise(F.concat(labels, F.lit(".")))


def prefix_sweep(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(key, stack)``: for every distinct ``key`` the ``prefix`` values that begin it, shortest first."""
    spark = keys.sparkSession
    # stack of a prefix: itself and the prefixes around it, found among its own beginnings
    begins = prefixes.select("prefix", F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("n")).select(
        "prefix", F.substring("prefix", F.lit(1), F.col("n")).alias("outer"))
    around = prefixes.select(F.col("prefix").alias("outer"))
    stacks = (begins.join(around, "outer").groupBy("prefix").agg(F.sort_array(F.collect_set("outer")).alias("stack")))
    binary = F.col("prefix").cast("binary")
    starts = stacks.select(binary.alias("at"), F.lit(0).alias("kind"), "stack", F.lit(None).cast("string").alias("key"))
    # no UTF-8 text holds the byte FF: prefix || FF follows everything that begins with the prefix
    ends = stacks.select(F.concat(binary, F.lit(bytearray(b"\xff"))).alias("at"), F.lit(0).alias("kind"),
                         F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"), F.lit(None).cast("string").alias("key"))
    points = keys.select(F.col("key").cast("binary").alias("at"), F.lit(1).alias("kind"),
                         F.lit(None).cast("array<string>").alias("stack"), "key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = write_shared(points.union(starts).union(ends).repartitionByRange(parts, "at", "kind")
                          .withColumn("part", F.spark_partition_id()), "sweep")
    # at most one row per partition: the stack it leaves open, handed to the partitions after it
    left = (ranged.where("kind = 0").groupBy("part").agg(F.max_by("stack", "at").alias("open"))
            .join(spark.range(parts).select(F.col("id").cast("int").alias("part")), "part", "right"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("part", F.last("open", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("at", "kind")
    return (ranged.join(F.broadcast(carried), "part", "left")
            .withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
            .select("key", F.coalesce("open", "carried", F.array().cast("array<string>")).alias("stack")))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``_row`` (the input row) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``verdict``, ``host``, ``path`` (a path begins with ``/``). A
    rule fits its host and all subdomains if the path begins with the rule's
    path. The longest rule (host and path together) wins; of equally long ones
    the one with the longer host, and of rules given twice the smaller verdict.
    No fitting rule: ``rule`` null and the ``default`` verdict. Null urls and
    urls without ``://`` have empty host and path and fit no rule; rules with a
    null or empty host are ignored, a null path is empty. Repeated rows are
    judged alike; empty tables give empty results, no rules the default.
    """
    rows = boxed(pages).withColumns({"host": host_of(F.col(f"_row.`{url_col}`")), "path": path_of(F.col(f"_row.`{url_col}`"))})
    urls = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    given = (rules.where("coalesce(host, '') != ''")
             .select(F.translate("host", AZ, AZ.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
             .withColumn("prefix", F.concat(reversed_host(F.col("host")), F.lit("\0"), F.col("path"))))
    pairs = write_shared(urls.distinct(), "urls")
    hosts = pairs.select("host").distinct().withColumn("key", reversed_host(F.col("host")))
    fitting = prefix_sweep(hosts.select("key"), given.select(reversed_host(F.col("host")).alias("prefix")).distinct())
    candidates = (pairs.join(hosts.join(fitting.where(F.size("stack") > 0), "key"), "host")
                  .select("host", "path", F.explode("stack").alias("rule_host"))
                  .withColumn("key", F.concat("rule_host", F.lit("\0"), F.col("path"))))
    longest = prefix_sweep(candidates.select("key").distinct(), given.select("prefix"))
    best = let(F.col("stack"), lambda s: F.get(s, F.size(s) - 1))
    named = given.select("prefix", F.length("prefix").alias("n"), F.length("host").alias("h"), "verdict",
                         F.concat("host", "path").alias("rule"))
    judged = (candidates.join(longest.where(F.size("stack") > 0).select("key", best.alias("prefix")), "key").join(named, "prefix")
              .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("n", "h")).alias("r")))
    return rows.join(judged, ["host", "path"], "left").select(
        "_row", "host", "path", "r.rule", F.coalesce("r.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")
