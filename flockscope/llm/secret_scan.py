"""Operator 4 - secret scans with corpus-wide ownership frequency (DataFrame only).

Base detectors mark spans by pattern. Their values and, beside them, opaque
tokens (long mixed runs no pattern names) are candidates. The corpus then says
who owns a candidate: its hash is counted by distinct repository and owner. A
value found under many owners or in many repositories is a widely copied
example; one that a single owner keeps in few repositories looks live. Opaque
tokens become spans only if they look live; base spans always stay.

Only (hash, owner, repository) rows are shuffled, reduced map-side before each
step, so a value copied a million times costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscope.llm.common import boxed, let, write_shared

#: Fixed patterns of the contract: kind, pattern, group of the value, least length of that value.
DETECTORS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: The same matches as "[0-9a-f]+" of 32 or more characters: greedy runs are maximal.
FAST = {"hex": r"[0-9a-f]{32,}"}
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = [k for k, *_ in DETECTORS] + ["opaque"]


#: Elements per block of a running sum.
BLOCK = 256


def running_starts(lengths: Column) -> Column:
    """Sums of the elements before each element of an int array that is not empty.

    An array that grows by one element is copied each time, so the sums are made
    block by block and the blocks' own starts from the blocks' totals: a text's
    million matches cost some hundred million copied numbers, not 10^12.
    """
    def grow(xs: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(
            (acc["at"] + x).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
            lambda acc: acc["starts"])

    def by_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        return let(grow(totals, F.lit(0)), lambda firsts: F.flatten(F.transform(blocks, lambda b, j: grow(b, F.get(firsts, j)))))

    cut = lambda xs: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda j: F.slice(xs, j * BLOCK + 1, F.lit(BLOCK)))
    return let(lengths, lambda xs: let(cut(xs), by_blocks))


def uncovered(spans: Column, base: Column) -> Column:
    """The spans (disjoint, by start) that overlap no base span.

    A base span overlaps if it starts before the span's end and does not end at
    or before its start, so the two counts are equal for a free span. Each count
    is a place in one sorted array of ends and starts.
    """
    point = lambda at, order, j: F.struct(at.alias("at"), order.alias("order"), j.alias("j"))
    def ranks(own: Column) -> Column:
        """For span j, the other points sorted before its own."""
        marked = F.transform(F.sort_array(own), lambda p, i: F.when(p["j"] >= 0, i - p["j"]))
        return F.filter(marked, lambda x: x.isNotNull())
    def points(edge: str, other: str, own_first: bool) -> Column:
        mine = F.transform(spans, lambda x, j: point(x[edge], F.lit(0 if own_first else 1), j))
        theirs = F.transform(base, lambda x: point(x[other], F.lit(1 if own_first else 0), F.lit(-1)))
        return F.concat(mine, theirs)
    free = let(ranks(points("e", "s", True)), lambda begun: let(ranks(points("s", "e", False)), lambda ended: F.filter(
        spans, lambda x, j: F.get(begun, j) == F.get(ended, j))))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(free)


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose value is long enough.

    Array of (s, k, e, v): start, kind number, end (code points, exclusive), value.
    Starts are running sums over the pieces between matches. Matches that are
    too short are dropped after matching, so they still use up their text.
    """
    span = "array<struct<s:int,k:int,e:int,v:string>>"

    def place(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        lengths = lambda xs: F.transform(xs, F.char_length)
        def walk(g: Column) -> Column:
            steps = F.transform(hits, lambda m, j: F.get(g, j) + F.char_length(m))
            return F.zip_with(running_starts(steps), F.slice(g, F.lit(1), F.size(hits)), lambda at, gap: at + gap)
        def build(starts: Column) -> Column:
            return let(values, lambda vs: F.transform(hits, lambda m, j: F.struct(
                F.get(starts, j).alias("s"), F.lit(kind).alias("k"),
                (F.get(starts, j) + F.char_length(m)).alias("e"), F.get(vs, j).alias("v"))))
        placed = let(let(lengths(gaps), walk), build)
        return F.when(F.size(hits) == 0, F.array().cast(span)).otherwise(
            F.filter(placed, lambda x: F.char_length(x["v"]) >= least).cast(span))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def written(spans: Column) -> Column:
    """``kind:start:end`` of the spans by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def ownership(candidates: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """``(h, n_owners, n_repos, live)`` of candidates ``(h, owner, repo)``."""
    once = candidates.groupBy("h", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n"))
    total = by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))
    return total.withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
         max_owners: int = 1, max_repos: int = 5) -> DataFrame:
    """``_row`` (the input row without its text) with ``base``, ``added`` (span arrays), ``n_live``, ``n_copied``.

    Spans are structs (s, k, e): start, kind number, end. ``n_live`` and
    ``n_copied`` count the row's candidates (base values and opaque tokens that
    overlap no base span) that look live or are widely copied. Null text is
    empty; null owners and repositories are one owner, one repository each.
    Repeated rows all get the same result and count as one repository. Ties:
    spans with equal start sort by kind, then end. A text's time grows with its
    length and little more than with its matches. Columns of any name go through
    in ``_row``. Empty table: empty result.
    """
    text = F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))
    found = [matches(text, FAST.get(kind, rx), group, least, i)
             for i, (kind, rx, group, least) in enumerate(DETECTORS)]
    opaque = F.filter(matches(text, OPAQUE, 0, 20, len(DETECTORS)), lambda x:
                      x["v"].rlike("[0-9]") & x["v"].rlike("[A-Z]") & x["v"].rlike("[a-z]"))
    rows = (boxed(docs)
            .select("_row", F.xxhash64(F.col(f"_row.`{repo_col}`"), F.col(f"_row.`{owner_col}`"), text).alias("rk"),
                    F.concat(*found).alias("spans"), opaque.alias("opaque")))
    free = let(F.struct("opaque", "spans"), lambda x: uncovered(x["opaque"], x["spans"]))
    bare = lambda xs: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    hashed = lambda xs: F.transform(xs, lambda x: F.struct(
        x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.sha2(x["v"], 256).alias("h")))
    others = [c for c in docs.columns if c != text_col]
    slim = rows.select(F.struct(*[F.col(f"_row.`{c}`") for c in others]).alias("_row"), "rk",
                       bare(F.col("spans")).alias("base"), hashed(F.concat("spans", free)).alias("cand"))
    slim = write_shared(slim, "secrets")
    seen = slim.select("rk", F.col(f"_row.`{owner_col}`").alias("owner"), F.col(f"_row.`{repo_col}`").alias("repo"),
                       F.explode("cand").alias("c"))
    verdict = ownership(seen.select(F.col("c.h").alias("h"), "owner", "repo"), max_owners, max_repos)
    judged = seen.select("rk", "repo", "c.*").distinct().join(verdict.select("h", "live"), "h")
    added = F.collect_list(F.when(F.col("live") & (F.col("k") == len(DETECTORS)), F.struct("s", "k", "e")))
    per_row = judged.groupBy("rk", "repo").agg(
        added.alias("added"), F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_copied"))
    out = slim.join(per_row.withColumnsRenamed({"rk": "_rk", "repo": "_repo"}),
                    (F.col("rk") == F.col("_rk")) & F.col(f"_row.`{repo_col}`").eqNullSafe(F.col("_repo")), "left")
    return out.select("_row", "base", F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int>>")).alias("added"),
                      F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
                      F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))
