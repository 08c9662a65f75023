"""Operator 7 - SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: a 64-bit majority vote over the XXH64 values of word shingles.
Linking: bit ``i`` carries a vector ``m(i)`` of ``radius + 1`` bits; table ``v``
(every non-zero vector) keeps the bits with an odd ``<m(i), v>``. Any ``radius``
vectors leave some ``v`` orthogonal to all of them, so two fingerprints within
the radius agree on all kept bits of some table: no pair is missed.

Buckets of a table are usually single fingerprints. Small buckets are compared
pair by pair. In a bucket above ``pair_bucket`` each fingerprint instead emits
every value within ``radius // 2`` flips (of the bits the table leaves out) and
fingerprints are linked to the smallest one that reaches the same value, plus,
for odd radii, one further flip on one side. Within an even radius, two
fingerprints that reach the same value are close, and any close pair reaches a
common value, so the links are exact at cost linear in the bucket.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscope.llm.common import boxed, write_shared
from flockscope.llm.components import star_edges

SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one text (see the module docstring).

    Null, empty and blank texts have no shingle and get 0; a text shorter than
    a shingle is one shingle. Only A-Z are folded.
    """
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return 0
    if len(w) > shingle:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    else:
        grams = iter([b" ".join(w)])
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded scratch for very long texts
        part = h[at:at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """Column of SimHash fingerprints (long), in Arrow batches."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    return run(text)


def covering_masks(radius: int = 2, bits: int = 64) -> list[int]:
    """Masks of the covering family, as signed 64-bit integers."""
    dim = radius + 1
    vec = [1 + i % ((1 << dim) - 1) for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vec[i] & v).bit_count() & 1) for v in range(1, 1 << dim)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _flips(mask: int, most: int) -> list[int]:
    """XOR values of up to ``most`` flips among the bits a table leaves out."""
    free = [i for i in range(64) if not mask >> i & 1]
    out = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(free, k)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def fingerprint_links(fps: DataFrame, radius: int = 2, pair_bucket: int = 64) -> DataFrame:
    """Links ``(a, b)``, a < b, whose closure is that of all pairs within ``radius``.

    ``fps`` has one distinct non-null long column ``fp``. Links of small
    buckets are all their close pairs; those of large ones are stars.
    """
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                 for t, m in enumerate(masks)]))
    keyed = fps.select("fp", tables.alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    busy = write_shared(keyed.join(sizes, ["t", "key"]), "simhash-buckets")
    small = busy.where(F.col("n") <= pair_bucket)
    pairs = (small.alias("x").join(small.alias("y"), ["t", "key"])
             .where((F.col("x.fp") < F.col("y.fp"))
                    & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius))
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    half, odd = divmod(radius, 2)
    large = busy.where(F.col("n") > pair_bucket)
    links = pairs
    for t, m in enumerate(masks):
        one = large.where(F.col("t") == t)
        reach = lambda most: F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in _flips(m, most)]))  # noqa: E731, B023
        near = one.select("fp", reach(half).alias("mid"))
        heads = near.groupBy("mid").agg(F.min("fp").alias("a"))
        if odd:
            # a flip more on one side: close to a value's head may be up to 2*half+1 <= radius apart
            near = one.select("fp", reach(half + 1).alias("mid"))
        star = near.join(heads, "mid").where(F.col("a") != F.col("fp"))
        links = links.unionByName(star.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")))
    return links.distinct()


def _grouped(docs: DataFrame, text_col: str, id_col: str, shingle: int, radius: int, **more: Column) -> DataFrame:
    """``id``, ``fp``, the columns of ``more`` and ``component_id`` of every row."""
    rows = boxed(docs).select(F.col(f"_row.`{id_col}`").alias("id"),
                              fingerprints(F.col(f"_row.`{text_col}`"), shingle).alias("fp"),
                              *[c.alias(k) for k, c in more.items()])
    rows = write_shared(rows, "simhash-fingerprints")
    distinct = write_shared(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    comps = star_edges(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    heads = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(heads, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp")


def near_duplicate_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                          shingle: int = 3, radius: int = 2) -> DataFrame:
    """Rows ``(id, fingerprint_value, component_id)``, one per input row.

    ``component_id`` is the smallest id linked to the row directly or through
    others, itself included. Equal fingerprints are linked (radius 0), so
    repeated rows and exact copies share a component. A row with a null id is
    linked like any other but never names a component (null if no member has
    an id). Null and blank texts have fingerprint 0. An empty table gives an
    empty result. Ties need no rule: the smallest id is unique.
    """
    groups = _grouped(docs, text_col, id_col, shingle, radius)
    return groups.select("id", F.col("fp").alias("fingerprint_value"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                         shingle: int = 3, radius: int = 2) -> DataFrame:
    """The documents whose id names their component: one id of each group.

    Input columns are returned unchanged. Rows with a null id are kept: they
    cannot be told apart and never name a group. Rows repeating the naming id
    are one document, so one of them stays: one whose own group the id names.
    """
    rows = boxed(docs)
    key, rk = F.col(f"_row.`{id_col}`"), F.xxhash64(F.col(f"_row.`{text_col}`"))
    groups = _grouped(docs, text_col, id_col, shingle, radius, rk=rk)
    heads = groups.where(F.col("id") == F.col("component_id")).groupBy(F.col("id").alias("_keep")).agg(F.min("rk").alias("_rk"))
    named = (rows.join(heads, (key == F.col("_keep")) & (rk == F.col("_rk")), "left_semi").groupBy(key.alias("_id"))
             .agg(F.min_by("_row", rk).alias("_row")))
    return named.select("_row.*").unionByName(rows.where(key.isNull()).select("_row.*"))
