"""Operator 9 - repeated runs of lines by winnowing (DataFrame only).

Lines with a word are hashed. Every window of ``min_run`` such lines owns one
fingerprint, its smallest line hash (the last one of equals): two texts that
share a run of ``min_run`` lines are guaranteed to share a fingerprint.
Positions of a fingerprint found only once are dropped at once. The others are
extended both ways to the windows that own them; of each distinct window the
first place stays and every later one is marked, so overlapping marked windows
make up the later repeated runs, which are deleted. On request a line of enough
words is a window by itself (``long_line``).

Rows shuffled are hashes and places. Fingerprints and first places come from
aggregates with map-side partial results, so a line in a third of all texts
costs a row per task; the joins back are plain equi-joins whose hot side Spark
splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscope.llm.common import BLANKS, boxed, let, words, write_shared

LINES = "array<struct<fp:bigint,at:int,s:int,key:bigint,li:array<int>>>"


def run_windows(text: Column, min_run: int, long_line: int | None = None) -> Column:
    """Windows of ``min_run`` lines of a text: fingerprint, its place, start, content hash, line numbers.

    With ``long_line``, also windows of one line of so many words.
    """
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(
        F.btrim(x, F.lit(BLANKS)) != "", F.struct(
            F.xxhash64(x).alias("h"), i.alias("i"), *([] if long_line is None else [(F.size(words(x)) >= long_line).alias("long")]))))

    def windows(lines: Column) -> Column:
        def one(s: Column) -> Column:
            part = F.slice(lines, s + 1, F.lit(min_run))
            low = F.array_min(F.transform(part, lambda x, j: F.struct(x["h"].alias("h"), (-j).alias("back"))))
            return let(low, lambda m: F.struct(
                m["h"].alias("fp"), (s - m["back"]).alias("at"), s.alias("s"),
                F.xxhash64(F.transform(part, lambda x: x["h"])).alias("key"),
                F.transform(part, lambda x: x["i"]).alias("li")))
        runs = F.when(F.size(lines) < min_run, F.array().cast(LINES)).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(lines) - min_run), one).cast(LINES))
        if long_line is None:
            return runs
        alone = F.transform(lines, lambda x, s: F.when(x["long"], F.struct(
            x["h"].alias("fp"), s.alias("at"), s.alias("s"), F.xxhash64(F.array(x["h"])).alias("key"), F.array(x["i"]).alias("li"))))
        return F.concat(runs, F.filter(alone, lambda x: x.isNotNull()).cast(LINES))

    return let(F.filter(numbered, lambda x: x.isNotNull()), windows)


def repeated_lines(rows: DataFrame, min_run: int, long_line: int | None = None) -> DataFrame:
    """``(id, rk, gone)``: numbers of the lines to delete, for rows ``(id, rk, text)`` that have any."""
    found = rows.select("id", "rk", F.explode(run_windows(F.col("text"), min_run, long_line)).alias("w")).select("id", "rk", "w.*")
    place = F.xxhash64("id", "rk", "at")
    shared = (found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"))
              .where("a != b").select("fp"))
    shared = write_shared(shared, "line-seeds")  # read back as a plain side, so that Spark may split a hot join
    # windows meet by keys of their own, not by the fingerprint: so no fingerprint's rows need stay together,
    # Spark may split a hot one in the join, and equal windows are reduced before they are shuffled
    extended = write_shared(found.join(shared, "fp").select("id", "rk", "s", "key", F.xxhash64("fp", "key").alias("key2"), "li"),
                            "line-windows")
    here = F.struct("id", "rk", "s")
    first = write_shared(extended.groupBy("key", "key2").agg(F.min(here).alias("first")), "line-firsts")
    later = extended.join(first, ["key", "key2"]).where(here != F.col("first"))
    return later.groupBy("id", "rk").agg(F.flatten(F.collect_list("li")).alias("gone"))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_run: int = 2,
                long_line: int | None = None) -> DataFrame:
    """``_row`` (the input row) with ``n_lines``, ``n_removed`` and ``kept_text``.

    A line is removed if it belongs to ``min_run`` successive lines (of those
    with a word) of its text that also stand, equal and in the same order,
    earlier: in a text with a smaller id, or higher up in the same text. With
    ``long_line``, a line of so many words or more that stands earlier goes
    without a neighbour too; else repeated lines that stand alone stay. Lines
    are split at LF and compared whole. Blank lines are skipped in runs and
    never removed. Null text has no lines and stays null; an empty text has one
    blank line. A null id comes before all others; rows of equal id and text
    count as one document (none is cut on account of its copy), rows of equal
    id and different text are ordered by text hash. Empty table: empty result.
    Lines and windows are compared by 64-bit hashes, windows within a fingerprint.
    """
    rows = boxed(docs)
    text, key = F.col(f"_row.`{text_col}`"), F.col(f"_row.`{id_col}`")
    rk = F.xxhash64(text)
    gone = repeated_lines(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("rk"),
                                      F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL"), min_run, long_line)
    out = rows.withColumn("_rk", rk).join(gone, (F.col("_rk") == F.col("rk")) & key.eqNullSafe(F.col("id")), "left")
    lines = F.split(text, "\n", -1)
    left = let(lines, lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    return out.select(
        "_row", F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.array_distinct("gone"))).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), text).otherwise(left).alias("kept_text"))
